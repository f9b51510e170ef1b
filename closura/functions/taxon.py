"""Expressions on lineage strings and stratum labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from closura.dataset import STRATUM_SEPARATOR
from closura.functions.rows import let

# The seven ranks, outermost first.
RANKS = ("domain", "phylum", "class", "order", "family", "genus", "species")


def tax_entity(taxon: Column, rank: str) -> Column:
    """The entry of a ``d__..; p__..`` lineage at ``rank``; empty or missing -> ``x__unknown``."""
    unknown = F.lit(f"{rank[0]}__unknown")
    part = F.trim(F.try_element_at(F.split(taxon, ";"), F.lit(RANKS.index(rank) + 1)))
    clean = F.regexp_replace(part, r"[\[\]]", "")
    return F.when(clean == f"{rank[0]}__", unknown).otherwise(F.coalesce(clean, unknown))


def tax_label_with_parent(taxon: Column, rank: str) -> Column:
    """Unknown entries take the label of the next higher rank, one level up only."""
    own = tax_entity(taxon, rank)
    parent = tax_entity(taxon, RANKS[RANKS.index(rank) - 1])
    return F.when(own == f"{rank[0]}__unknown", F.concat(F.lit(f"{rank[0]}__unkn_"), parent)).otherwise(own)


def leaf_name(taxon: Column, feature: Column) -> Column:
    return F.concat(taxon, F.lit("; otu__"), feature)


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two strings."""

    def cut(s: Column) -> Column:
        shorter = F.least(F.length(s["a"]), F.length(s["b"]))
        positions = F.sequence(F.lit(1), F.greatest(shorter, F.lit(1)))
        differs = F.filter(positions, lambda i: ~s["a"].substr(i, F.lit(1)).eqNullSafe(s["b"].substr(i, F.lit(1))))
        return s["a"].substr(F.lit(1), F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, shorter))

    return let(F.struct(a.alias("a"), b.alias("b")), cut)


def before_last_semicolon(s: Column) -> Column:
    """Text before the last ``;``; the empty string when there is none."""
    return F.when(F.instr(s, ";") > 0, F.regexp_replace(s, ";[^;]*$", "")).otherwise(F.lit(""))


def stratum_label(cols: list[str]) -> Column:
    return F.concat_ws(STRATUM_SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols])
