"""Language identification in two steps: a language family, then one-versus-one machines inside the family.

Features are shares of hashed letter trigrams (of UTF-8 bytes, lower case, runs of other characters as one blank). All
machines are linear support vector machines with squared hinge loss, solved to convergence by Newton steps on the training
rows: one against the rest for families, one for each pair of languages of a family. Scoring is one gather from a small
weight table for each byte and a sum for each text, so it costs the same for any number of documents and is not shuffled.

Training reads a sample of at most about ``sample`` rows of each language (picked by a hash of the id, spread evenly over all
labelled rows); the bound is a parameter. Everything else covers all rows.

Null texts and texts without a letter are ``und`` with score 0; so is every text when nothing could be learned. Rows that repeat are judged
each, texts of any length whole. An empty table gives no rows. A column named like the result is replaced.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.words import attach, emit, raw

UNKNOWN = "und"
SAMPLE = 400
DIMS = 1 << 13
REGULAR = 1e-2
RESULT = "struct<lang:string,score:double>"

#: Language families by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi", "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk", "baltic": "lt lv", "celtic": "br cy ga gd", "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt uz", "indic": "bn gu hi mr ne pa si ur", "iranic": "fa ku ps tg", "dravidian": "kn ml ta te",
    "semitic": "am ar he mt", "malayic": "id jv ms tl",
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts in turn, and where each text's begin (one more at the end)."""
    data, offsets = raw(pc.utf8_lower(texts))
    kept = np.where(((data >= 97) & (data <= 122)) | (data >= 128), data, 32).astype(np.uint32)
    if len(kept) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = kept[:-2] << np.uint32(16) | kept[1:-1] << np.uint32(8) | kept[2:]
    blank = kept == 32
    good = ~(blank[:-2] & blank[1:-1]) & ~(blank[1:-1] & blank[2:])
    edge = offsets[(offsets > 0) & (offsets < len(data))]  # a trigram does not span two texts
    for back in (1, 2):
        at = edge - back
        good[at[(at >= 0) & (at < len(good))]] = False
    at = np.flatnonzero(good)
    slot = (code[at] * np.uint32(2654435761)) >> np.uint32(32 - DIMS.bit_length() + 1)
    return slot.astype(np.int64), np.searchsorted(at, offsets)


def shares(slots: np.ndarray) -> np.ndarray:
    return np.bincount(slots, minlength=DIMS).astype(np.float32) / max(1, len(slots))


def machine(gram: np.ndarray, y: np.ndarray, regular: float = REGULAR, rounds: int = 30) -> np.ndarray:
    """Dual weights of a linear machine with squared hinge loss (the last one is the bias)."""
    n = len(y)
    beta, bias, support = np.zeros(n), 0.0, np.ones(n, dtype=bool)
    for _ in range(rounds):
        at = np.flatnonzero(support)
        system = np.zeros((len(at) + 1, len(at) + 1))
        system[:-1, :-1] = gram[np.ix_(at, at)] + regular * np.eye(len(at))
        system[-1, :-1] = system[:-1, -1] = 1
        found = np.linalg.lstsq(system, np.r_[y[at], 0], rcond=None)[0] if len(at) < 3 else np.linalg.solve(system, np.r_[y[at], 0])
        beta[:] = 0
        beta[at], bias = found[:-1], found[-1]
        now = y * (gram @ beta + bias) < 1
        if (now == support).all() or not now.any():
            break
        support = now
    return np.r_[beta, bias]


class Model:
    """Weights of all machines side by side: (kind, first, second) for each column."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        own, fam = np.array(langs), np.array([family_of(v) for v in langs])
        self.families: dict[str, list[str]] = defaultdict(list)
        for lang in sorted(set(langs)):
            self.families[family_of(lang)].append(lang)
        scale = (1 / np.sqrt(x.mean(axis=0, dtype=np.float64) + 1e-6)).astype(np.float32)
        x *= scale  # in place: this is the largest thing that the driver holds
        norm = float(np.sqrt(np.einsum("ij,ij->", x, x) / max(1, len(x)))) or 1.0
        x /= np.float32(norm)
        self.machines, columns = [], []
        gram = (x @ x.T).astype(np.float64)

        def add(kind: str, a: str, b: str, rows: np.ndarray, y: np.ndarray) -> None:
            at = np.flatnonzero(rows)
            found = machine(gram[np.ix_(at, at)], y[at])
            self.machines.append((kind, a, b))
            columns.append(np.r_[(found[:-1].astype(np.float32) @ x[at]) * scale / norm, found[-1]])

        if len(self.families) > 1:
            for f in sorted(self.families):
                add("family", f, "", np.ones(len(own), dtype=bool), np.where(fam == f, 1.0, -1.0))
        for f, members in sorted(self.families.items()):
            for i, a in enumerate(members):
                for b in members[i + 1:]:
                    add("pair", a, b, (own == a) | (own == b), np.where(own == a, 1.0, -1.0))
        table = np.array(columns, dtype=np.float32).T if columns else np.zeros((DIMS + 1, 0), np.float32)
        self.weights, self.bias, self.families = np.ascontiguousarray(table[:-1]), table[-1], dict(self.families)

    @classmethod
    def of(cls, parts: dict) -> Model:
        """From plain data, as it travels to tasks (``vars`` of a model)."""
        made = cls.__new__(cls)
        made.__dict__.update(parts)
        return made

    def margins(self, texts: pa.Array) -> np.ndarray:
        slots, first = trigrams(texts)
        total = np.zeros((len(slots) + 1, len(self.machines)))
        for m in range(len(self.machines)):
            np.cumsum(self.weights[slots, m], dtype=np.float64, out=total[1:, m])
        size = np.maximum(1, np.diff(first))[:, None]
        return (total[first[1:]] - total[first[:-1]]) / size + self.bias

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
        if not self.families:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        margins, names = self.margins(texts), list(sorted(self.families))
        at = {m: i for i, m in enumerate(self.machines)}
        langs, scores = [], []
        for row, known in zip(margins, letters, strict=True):
            if not known:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            score = 1.0
            if len(names) > 1:
                own = [row[at["family", f, ""]] for f in names]
                best = int(np.argmax(own))
                family, score = names[best], chance(own[best] - max(v for i, v in enumerate(own) if i != best))
            else:
                family = names[0]
            members = self.families[family]
            votes, sums = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
            for i, a in enumerate(members):
                for b in members[i + 1:]:
                    margin = row[at["pair", a, b]]
                    votes[a if margin >= 0 else b] += 1
                    sums[a] += margin
                    sums[b] -= margin
            lang = min(members, key=lambda v: (-votes[v], -sums[v], v))
            for rival in members:
                if rival != lang:
                    margin = row[at["pair", lang, rival]] if (("pair", lang, rival) in at) else -row[at["pair", rival, lang]]
                    score = min(score, chance(2 * margin))
            langs.append(lang)
            scores.append(float(score))
        return langs, scores


def chance(margin: float) -> float:
    return 1 / (1 + float(np.exp(-np.clip(2 * margin, -40, 40))))


def holdout(column, folds: int, fold: int):
    """Whether an id falls into a fold by the checksum of its text; a null id does not."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, *, sample: int = SAMPLE, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fits the model on a bounded sample of the rows of ``docs`` that have a language and a text with letters."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().toLocalIterator()}
    if not counts:
        return Model(np.zeros((0, DIMS), np.float32), [])
    share = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, sample / n))])
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("text", "lang")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            slots, first = trigrams(batch.column("text"))
            at, part = [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                x = shares(slots[a:b])
                used = np.flatnonzero(x)
                at.append(used.astype(np.uint16).tobytes())
                part.append(x[used].tobytes())
            return pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(at, pa.binary()), pa.array(part, pa.binary())],
                                              names=["lang", "at", "part"])
        return run

    got = emit(drawn, "text", "lang string, at binary, part binary", make).toArrow()
    got = got.sort_by([("lang", "ascending"), ("at", "ascending"), ("part", "ascending")])
    x = np.zeros((len(got), DIMS), np.float32)
    for i, (at, part) in enumerate(zip(got["at"], got["part"], strict=True)):
        x[i, np.frombuffer(at.as_buffer(), np.uint16)] = np.frombuffer(part.as_buffer(), np.float32)
    langs = got["lang"].to_pylist()
    del got
    return Model(x, langs)


def identify(docs: DataFrame, model: Model, *, text: str = "text", out: str = "found") -> DataFrame:
    """``docs`` with a struct ``out``: language and score. A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def make():
        known = Model.of(shared.value)

        def run(texts: pa.Array) -> pa.Array:
            langs, scores = known.predict(texts)
            return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])
        return run

    return attach(docs, text, out, RESULT, make)
