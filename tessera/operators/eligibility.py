"""Which records take part: label rules, product and source scope, refusals, and the members of a study's view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.scores import first_reason

#: Labels that name an intermediate, a temporary identity or a missing number, and flags that block a record.
INTERMEDIATE = r"(?iU)^(?:Intermediates?(?=$|[\s_:.：\-－0-9０-９])|interm[.\s_]|(?:中间体|中間体|中間體))"
TEMPORARY = r"(?iU)^(?:source-structure:|编号待确认|未关联结构|关联结构\s+[a-f0-9]{6})"
MISSING_NUMBERS = ("-", "--", "—", "–", "n/a", "nan", "none", "null", "undefined", "unnumbered", "unassigned", "无编号", "未编号", "编号缺失", "编号待定")
UNCONFIRMED = ("missing_or_invalid_identifier", "structure_number_unconfirmed")
UNPROVED = ("unassociated_structure", "structure_number_unconfirmed", "ambiguous_binding", "structure_unmatched", "structure_not_generated", "structure_generation_failed")
BLOCKED = ("structure_number_unconfirmed", "ambiguous_binding", "ambiguous_smiles", "historical_identity", "structure_unmatched")
SCOPES = ("all", "strong", "leads", "changes", "strong_changes")
SPACE = r"(?U)^\s+|\s+$"


def _text(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), SPACE, "")


def _has(flags: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(flags, F.array(*[F.lit(n) for n in names])), F.lit(False))


def is_intermediate(*labels: Column) -> Column:
    """Whether any of the label fields declares an intermediate; a prefix "I-" or a word inside prose doesn't."""
    found = F.lit(False)
    for label in labels:
        found = found | _text(label).rlike(INTERMEDIATE)
    return found


def numbered_product(identity: Column, structure: Column, kind: Column, flags: Column, *labels: Column) -> Column:
    """A record with a structure of its own, not of activity alone, not of a source drawing, unblocked, and no intermediate."""
    own = (F.coalesce(structure, F.lit("")) != "") & (F.coalesce(kind, F.lit("")) != "activity_only") & ~F.coalesce(identity, F.lit("")).startswith("source-structure:")
    return own & ~_has(flags, UNPROVED) & ~is_intermediate(*labels)


def source_exclusion(label: Column, source: Column, issues: Column) -> Column:
    """unconfirmed_identifier, intermediate, or null for a record that takes part."""
    raw, own, origin = F.coalesce(label, F.lit("")), _text(label), _text(source)
    control = r"[\x00-\x1F]"
    unconfirmed = (
        raw.rlike(control) | (own == "") | F.lower(own).isin(*MISSING_NUMBERS) | (F.length(own) > 200)
        | F.coalesce(source, F.lit("")).rlike(control) | own.rlike(TEMPORARY) | F.lower(origin).startswith("source-structure:") | _has(issues, UNCONFIRMED)
    )
    return F.when(unconfirmed, "unconfirmed_identifier").when(is_intermediate(own, origin), "intermediate")


def lead_refusal(record: dict[str, Column]) -> Column:
    """Why a record may not be ranked, the first reason that holds; null if it may.

    record: id, confidence, structure, image, page, flags, review (decision), stale (correction), recognition (status), quality (flag), graph (usable).
    """
    r = record
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    unproved = r["id"].startswith("source-structure:") | (F.coalesce(r["confidence"], F.lit("")) != "high") | empty(r["structure"]) | empty(r["image"]) | ~F.coalesce(r["page"].between(1, 20_000), F.lit(False)) | _has(r["flags"], BLOCKED)
    recognised = (F.coalesce(r["recognition"], F.lit("")) == "valid") & F.coalesce(r["quality"].isin("ok", "manual_correction"), F.lit(False))
    return first_reason([
        (unproved, "ownership_unproved"),
        (F.coalesce(r["review"].isin("rejected", "needs_review"), F.lit(False)), "review"),
        (F.coalesce(r["stale"], F.lit(False)), "stale_correction"),
        (~recognised, "recognition"),
        (~F.coalesce(r["graph"], F.lit(False)), "graph"),
    ])


def in_scope(rows: DataFrame, scope: str = "all", scaffolds: DataFrame | None = None, fragments: DataFrame | None = None, scaffold: object = None, region: object = None, fragment: object = None, reference: object = None) -> DataFrame:
    """The study's rows (molecule, strong, candidate_status) that a view shows.

    scaffolds: (scaffold, molecule); fragments: (region, reference, fragment, is_reference, molecule). A scope of
    changes leaves out the reference's own fragment and the reference itself. Selections that name nothing are refused.
    """
    if scope not in SCOPES:
        raise ValueError(f"no such scope: {scope}")
    if fragment is not None and region is None:
        raise ValueError("a fragment needs its region")

    def chosen(table: DataFrame, what: str, value: object) -> DataFrame:
        if value is None:
            return table
        found = table.where(F.col(what) == F.lit(value))
        if found.isEmpty():
            raise ValueError(f"no such {what} in this study, or under another selection: {value}")
        return found

    if scaffold is not None:
        rows = rows.join(chosen(scaffolds, "scaffold", scaffold).select("molecule").distinct(), "molecule", "left_semi")
    if region is not None or reference is not None:
        members = chosen(chosen(chosen(fragments, "reference", reference), "region", region), "fragment", fragment)
        if scope in ("changes", "strong_changes"):
            members = members.where(~F.col("is_reference") & (F.col("molecule") != F.col("reference")))
        rows = rows.join(members.select("molecule").distinct(), "molecule", "left_semi")
    if scope in ("strong", "strong_changes"):
        rows = rows.where("strong")
    return rows.where("candidate_status = 'selected'") if scope == "leads" else rows
