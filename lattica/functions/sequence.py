"""Sequence and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """Letters other than ACGT (either case) stay."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def gc_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.regexp_replace(seq, "[GCgc]", ""))


def read_base(read_id: Column) -> Column:
    """All but the last part of a dotted id."""
    return F.regexp_extract(read_id, r"^(.*)\.([^.]*)$", 1)


def read_mate(read_id: Column) -> Column:
    return F.regexp_extract(read_id, r"^(.*)\.([^.]*)$", 2)


def flag_reverse(flag: Column) -> Column:
    """Whether bit 0x10 of an alignment flag is set."""
    return flag.bitwiseAND(16) != 0


def taxon_ranks(taxonomy: Column) -> Column:
    return F.transform(F.split(taxonomy, ";"), lambda x: F.trim(x))


def taxon_with_confidence(name_conf: Column) -> Column:
    """`name;0.98765` to `name(0.987)`; `Unclassified` stays."""
    parts = F.split(name_conf, ";")
    return F.when(name_conf.startswith("Unclassified"), F.lit("Unclassified")).otherwise(F.concat(F.element_at(parts, 1), F.lit("("), F.substring(F.element_at(parts, 2), 1, 5), F.lit(")")))
