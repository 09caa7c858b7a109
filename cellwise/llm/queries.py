"""The queries of this subpackage, each over its whole tables, and SQL for those that SQL can state."""

from __future__ import annotations

from . import oracles
from .classifier import fit, score
from .common import table
from .decontaminate import contamination
from .licenses import scan
from .packing import pack
from .quality import quality_rules
from .simhash import near_duplicates
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_files import token_files
from .warc import warc_round_trip


def tokenizer(name: str) -> str:
    """A public tokenizer's file, installed beside the libraries on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))


def op3_token_files(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def op5_suffix_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_best_two_fit(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), remember=True)


def op7_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_compression_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op9_warc(spark, sf_dir):
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_substring_dedup, op3_token_files, op4_license_scan, op5_suffix_decontamination, op6_best_two_fit, op7_simhash, op8_compression_quality, op9_warc, op10_quality_rules)}
ORACLES: dict[str, str] = {
    "op2_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op5_suffix_decontamination": oracles.DECONTAMINATION,
    "op10_quality_rules": oracles.QUALITY,
}
