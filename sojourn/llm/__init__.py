"""Operators for training data. Nothing outside this package imports it.

Kernels that run inside tasks are shipped by value, so executors need not have the package on their path.
"""

import importlib

from pyspark import cloudpickle

KERNELS = ("words", "decontaminate", "substrings", "similar", "packing", "warc", "languages", "quality", "toxicity",
           "scoring", "trees", "extraction")

for _name in KERNELS:
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_name}"))
