"""The registered queries of this subpackage and the SQL that checks them."""

from importlib import import_module

MODULES = ("kneser_ney", "suffix_dedup", "decontaminate", "toxicity", "sentencepiece_codec", "minhash_join", "topk_search", "chat_format", "training_order", "language")

QUERIES, ORACLES = {}, {}
for _m in MODULES:
    _x = import_module(f"quillrank.llm.{_m}")
    QUERIES.update(_x.QUERIES)
    ORACLES.update(_x.ORACLES)
