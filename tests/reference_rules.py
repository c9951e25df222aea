"""Plain sequential definitions, used as brute force on small fixtures."""

import math


def meters(lat1, lng1, lat2, lng2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def stays(track, radius=100.0, min_sec=600, max_gap=7200):
    """track: time-sorted (ts, lat, lng, label). Gives (start, end, count, label)."""
    found, i, n = [], 0, len(track)
    while i < n:
        j = i + 1
        while j < n and track[j][0] - track[j - 1][0] <= max_gap and meters(*track[i][1:3], *track[j][1:3]) <= radius:
            j += 1
        if track[j - 1][0] - track[i][0] < min_sec:
            i += 1
            continue
        seen = {}
        for p in track[i:j]:
            if p[3]:
                seen[p[3]] = seen.get(p[3], 0) + 1
        found.append((track[i][0], track[j - 1][0], j - i, max(seen, key=seen.get) if seen else None))
        i = j
    return found


def clusters(spots, eps, min_pts, weights=None):
    """spots: (lat, lng) in id order. Cluster id per spot; noise is -1."""
    n = len(spots)
    near = [[j for j in range(n) if meters(*spots[i], *spots[j]) <= eps] for i in range(n)]
    core = [sum(weights[j] if weights else 1 for j in near[i]) >= min_pts for i in range(n)]
    label = [-1] * n
    k = 0
    for i in range(n):
        if not core[i] or label[i] >= 0:
            continue
        stack = [i]
        label[i] = k
        while stack:
            for j in near[stack.pop()]:
                if core[j] and label[j] < 0:
                    label[j] = k
                    stack.append(j)
        k += 1
    for i in range(n):
        if not core[i]:
            label[i] = min((label[j] for j in near[i] if core[j]), default=-1)
    return label
