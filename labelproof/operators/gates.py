"""Quality gates. A gate is a table of checks: name, status, evidence, required action."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.operators import balance, joins, profile
from labelproof.operators.reshape import in_order, set_difference, stack_frames
from labelproof.session import one_row

SEVERITY = ("FAIL", "WARN", "MANUAL", "PASS")


def side_by_side(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames of exactly one row each as one row; every frame is a scalar subquery, run side by side."""
    columns = []
    for frame in frames:
        row = one_row(frame)
        columns += [row.getField(c).alias(c) for c in frame.columns]
    return frames[0].sparkSession.range(1).select(*columns)


@dataclass(frozen=True)
class Check:
    name: str
    passed: Column
    evidence: Column
    action: str = ""
    otherwise: str = "FAIL"

    def row(self) -> Column:
        ok = F.coalesce(self.passed, F.lit(False))
        return F.struct(
            F.lit(self.name).alias("check_name"),
            F.when(ok, "PASS").otherwise(self.otherwise).alias("status"),
            F.coalesce(self.evidence.cast("string"), F.lit("")).alias("evidence"),
            F.when(ok, "").otherwise(self.action).alias("required_action"),
        )


def gate_rows(facts: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Turn one row of facts into one row per check."""
    return facts.select(F.inline(F.array(*[c.row() for c in checks])))


def by_severity(results: DataFrame) -> DataFrame:
    return results.orderBy(in_order("status", SEVERITY), "check_name")


def count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def structure_gate(
    items: DataFrame,
    assignments: DataFrame,
    *,
    key: str,
    entity: str,
    target: str,
    split: str,
    targets: Sequence[str],
    splits: Sequence[str],
    expected_items: int | None = None,
    expected_entities: int | None = None,
) -> DataFrame:
    """Row count, unique key, entity count, exact target and split sets, leakage, assignment match."""
    base = items.groupBy(entity, target, split).agg(F.count(F.lit(1)).alias("__n"))
    entities = base.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.countDistinct(split).alias("__s"))
    facts = side_by_side(
        [
            items.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys")),
            entities.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("__s") > 1).alias("leaked")),
            base.agg(
                F.count_if(~F.coalesce(F.col(target).isin(*targets), F.lit(False))).alias("odd_targets"),
                F.countDistinct(F.when(F.col(target).isin(*targets), F.col(target))).alias("known_targets"),
                F.count_if(~F.coalesce(F.col(split).isin(*splits), F.lit(False))).alias("odd_splits"),
                F.countDistinct(F.when(F.col(split).isin(*splits), F.col(split))).alias("known_splits"),
            ),
            count_rows(
                joins.assignment_difference(base, assignments, [entity, target, split]), "differences"
            ),
        ]
    )
    c = F.col
    checks = [
        Check("unique item key", c("rows") == c("keys"), c("rows") - c("keys"), "remove repeated keys"),
        Check("target set", (c("odd_targets") == 0) & (c("known_targets") == len(targets)), c("known_targets"), "fix target labels"),
        Check("split set", (c("odd_splits") == 0) & (c("known_splits") == len(splits)), c("known_splits"), "fix split labels"),
        Check("entity leakage", c("leaked") == 0, c("leaked"), "keep each entity in one split"),
        Check("assignment match", c("differences") == 0, c("differences"), "regenerate from the recorded split"),
    ]
    if expected_items is not None:
        checks.insert(0, Check("item count", c("rows") == expected_items, c("rows"), f"expected {expected_items} items"))
    if expected_entities is not None:
        checks.append(Check("entity count", c("entities") == expected_entities, c("entities"), f"expected {expected_entities} entities"))
    return gate_rows(facts, checks)


def generated_gate(
    items: DataFrame,
    assignments: DataFrame,
    *,
    key: str,
    entity: str,
    target: str,
    split: str,
    text: str,
    signature: str,
    targets: Sequence[str],
    items_per_entity: int,
    entities_per_target: int,
    split_entities: dict[str, int],
) -> DataFrame:
    """Exact counts per entity, target and split, leakage, assignment match, equal texts and signatures per target."""
    n = items_per_entity
    total_entities = len(targets) * entities_per_target
    cells = items.groupBy(entity, target, split).agg(F.count(F.lit(1)).alias("__n"))
    per_entity = cells.groupBy(entity).agg(F.sum("__n").alias("__n"), F.countDistinct(split).alias("__s"))
    per_target = cells.groupBy(target).agg(F.sum("__n").alias("__n"))
    per_split = cells.groupBy(split).agg(F.sum("__n").alias("__n"))
    wanted_split = F.coalesce(
        *[F.when(F.col(split) == s, F.lit(c * len(targets) * n)) for s, c in split_entities.items()], F.lit(-1)
    )
    facts = side_by_side(
        [
            items.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys")),
            per_entity.agg(
                F.count(F.lit(1)).alias("entities"),
                F.count_if(F.col("__n") != n).alias("odd_entities"),
                F.count_if(F.col("__s") > 1).alias("leaked"),
            ),
            per_target.agg(
                F.count_if(F.col("__n") == entities_per_target * n).alias("good_targets"), F.count(F.lit(1)).alias("all_targets")
            ),
            per_split.agg(F.count_if(F.col("__n") == wanted_split).alias("good_splits"), F.count(F.lit(1)).alias("all_splits")),
            count_rows(joins.assignment_difference(cells, assignments, [entity, target, split]), "differences"),
            count_rows(balance.unequal_multisets(items, target, signature, targets[0]), "odd_signatures"),
            count_rows(balance.unequal_multisets(items, target, text, targets[0]), "odd_texts"),
        ]
    )
    c = F.col
    return gate_rows(
        facts,
        [
            Check("item count", c("rows") == total_entities * n, c("rows"), f"expected {total_entities * n} items"),
            Check("unique item key", c("rows") == c("keys"), c("rows") - c("keys"), "remove repeated keys"),
            Check("items per entity", (c("odd_entities") == 0) & (c("entities") == total_entities), c("odd_entities"), f"expected {n} items for each of {total_entities} entities"),
            Check("items per target", (c("good_targets") == len(targets)) & (c("all_targets") == len(targets)), c("good_targets"), "rebalance targets"),
            Check("items per split", (c("good_splits") == len(split_entities)) & (c("all_splits") == len(split_entities)), c("good_splits"), "rebalance splits"),
            Check("entity leakage", c("leaked") == 0, c("leaked"), "keep each entity in one split"),
            Check("assignment match", c("differences") == 0, c("differences"), "regenerate from the recorded split"),
            Check("effects independent of target", c("odd_signatures") == 0, c("odd_signatures"), "draw effects from the seed only"),
            Check("texts independent of target", c("odd_texts") == 0, c("odd_texts"), "share texts between targets"),
        ],
    )


BLOCKING = (
    "missing",
    "corrupt",
    "blank",
    "low_pixel_contrast",
    "wrong_size",
    "duplicate_groups",
    "entity_overlap",
    "serious_imbalance",
    "strong_association",
)


def blocking_gate(facts: DataFrame) -> DataFrame:
    """One check per blocking value; any value other than 0 fails."""
    return gate_rows(facts, [Check(b, F.col(b) == 0, F.col(b), "resolve before training") for b in BLOCKING])


def file_gate(listed: DataFrame, images: DataFrame, files: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """Every listed file exists inside the folder, is not empty, opens, has its declared size and is not blank; no unlisted file.

    ``listed`` has the path and the declared ``image_size``; ``images`` has
    decoded sizes and the grey ``intensity_range``; ``files`` has lengths.
    """
    joined = listed.join(files.select(path, "length"), path, "left").join(
        images.select(path, "decoded", "width", "height", "intensity_range"), path, "left"
    )
    opened = F.coalesce("decoded", F.lit(False))
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    facts = side_by_side(
        [
            joined.agg(
                F.count(F.lit(1)).alias("listed"),
                F.count_if(F.col("length").isNull()).alias("absent"),
                F.count_if(~F.col(path).startswith(folder.rstrip("/") + "/")).alias("outside"),
                F.count_if(F.col("length") == 0).alias("empty"),
                F.count_if(F.col("length").isNotNull() & ~opened).alias("unreadable"),
                F.count_if(opened & (size != F.col("image_size"))).alias("wrong_size"),
                F.count_if(opened & (F.col("intensity_range") == 0)).alias("blank"),
            ),
            count_rows(files.select(path).join(listed.select(path).distinct(), path, "left_anti"), "unlisted"),
        ]
    )
    names = {
        "absent": "files exist",
        "outside": "files inside the folder",
        "empty": "files not empty",
        "unreadable": "files open",
        "wrong_size": "declared size",
        "blank": "images not blank",
        "unlisted": "no unlisted file",
    }
    return gate_rows(facts, [Check(n, F.col(c) == 0, F.col(c), "fix the file set") for c, n in names.items()])


@dataclass(frozen=True)
class SelfCheck:
    """Settings of the self-check of one table."""

    kind: str = "tabular"  # tabular, text, image or unsupervised
    target: str | None = None
    split: str | None = None
    group: str | None = None
    time: str | None = None
    text: str | None = None
    group_overlap_forbidden: bool = True
    imbalance_percent: float = 15.0
    scale_limit: float = 100.0
    keywords: dict[str, Sequence[str]] = field(default_factory=dict)


def self_check(df: DataFrame, settings: SelfCheck, documents: DataFrame | None = None) -> DataFrame:
    """Data checks for any table, most severe first.

    ``documents`` (columns name, text) holds the evidence documents; each one
    named in ``settings.keywords`` must exist and mention its keywords.
    """
    c = F.col
    parts: list[DataFrame] = []
    if documents is not None and settings.keywords:
        parts += _evidence_checks(documents, settings.keywords)
    columns = profile.column_profile(df)
    constant = columns.agg(
        F.array_join(F.array_sort(F.collect_list(F.when(c("distinct_values") <= 1, c("column")))), ",").alias("names")
    )
    parts.append(gate_rows(constant, [Check("constant columns", c("names") == "", c("names"), "remove or justify them", "WARN")]))
    repeated = profile.duplicate_row_count(df)
    parts.append(gate_rows(repeated, [Check("exact duplicate rows", c("duplicate_rows") == 0, c("duplicate_rows"), "investigate the copies", "WARN")]))
    ids = profile.identifier_like(df.columns)
    one = df.sparkSession.range(1)
    parts.append(
        gate_rows(one, [Check("identifier-like columns", F.lit(not ids), F.lit(",".join(ids)), "keep identifiers out of the features", "MANUAL")])
    )
    parts.append(_target_check(df, settings, one))
    parts += _split_checks(df, settings, one)
    parts += _kind_checks(df, settings, one)
    return by_severity(stack_frames(parts))


def _evidence_checks(documents: DataFrame, keywords: dict[str, Sequence[str]]) -> list[DataFrame]:
    """Per name: whether it has a document at all, and whether any of its documents holds each keyword.

    One aggregate row with a flag per configured name and keyword; texts stay on their rows.
    """
    named = {name: F.col("name") == name for name in keywords}
    text = F.lower("text")
    flags = [F.coalesce(F.bool_or(is_it), F.lit(False)).alias(f"there_{i}") for i, is_it in enumerate(named.values())]
    rows = []
    for i, (name, words) in enumerate(keywords.items()):
        there = F.col(f"there_{i}")
        for k, word in enumerate(words):
            holds = named[name] & F.coalesce(text.contains(word.lower()), F.lit(False))
            flags.append(F.coalesce(F.bool_or(holds), F.lit(False)).alias(f"holds_{i}_{k}"))
            rows.append((there, F.col(f"holds_{i}_{k}"), f"{name} mentions {word}", name, "add a clear section", "WARN"))
        rows.append((F.lit(True), there, f"document {name}", name, "add the document", "FAIL"))
    facts = documents.filter(F.col("name").isin(list(keywords))).agg(*flags)
    structs = [
        F.struct(
            asked.alias("asked"),
            F.lit(check).alias("check_name"),
            F.when(passed, "PASS").otherwise(failing).alias("status"),
            F.lit(name).alias("evidence"),
            F.when(passed, "").otherwise(action).alias("required_action"),
        )
        for asked, passed, check, name, action, failing in rows
    ]
    # keywords of a name without documents are not asked for
    return [facts.select(F.inline(F.array(*structs))).filter("asked").drop("asked")]


def _target_check(df: DataFrame, s: SelfCheck, one: DataFrame) -> DataFrame:
    c = F.col
    if s.kind == "unsupervised" or s.target is None:
        return gate_rows(one, [Check("unsupervised objective", F.lit(False), F.lit("no target expected"), "document the evaluation plan", "MANUAL")])
    if s.target not in df.columns:
        return gate_rows(one, [Check("target column exists", F.lit(False), F.lit(s.target), "correct the target column")])
    status = profile.imbalance_status(profile.target_distribution(df, s.target), s.imbalance_percent)
    return gate_rows(
        status, [Check("target distribution", c("status") == "PASS", c("values"), "keep ratios; justify metrics", "WARN")]
    )


def _split_checks(df: DataFrame, s: SelfCheck, one: DataFrame) -> list[DataFrame]:
    c = F.col
    if s.split is None or s.split not in df.columns:
        return [gate_rows(one, [Check("split verification", F.lit(False), F.lit("no split column"), "provide split evidence", "MANUAL")])]
    side = profile.split_side(s.split)
    sides = df.agg(F.count_if(side == "train").alias("t"), F.count_if(side == "validation").alias("v"))
    out = [
        gate_rows(
            sides,
            [Check("both sides present", (c("t") > 0) & (c("v") > 0), F.concat_ws("/", c("t"), c("v")), "provide split evidence", "MANUAL")],
        )
    ]
    if s.group and s.group in df.columns:
        train, valid = df.filter(side == "train"), df.filter(side == "validation")
        shared = count_rows(joins.shared_groups(train, valid, s.group), "n")
        worse = "FAIL" if s.group_overlap_forbidden else "MANUAL"
        out.append(gate_rows(shared, [Check("group overlap", c("n") == 0, c("n"), "use a group-aware split", worse)]))
    if s.time and s.time in df.columns:
        edge = profile.time_boundary(df, s.time, s.split)
        out.append(
            gate_rows(edge, [Check("chronological boundary", c("chronological"), c("chronological"), "train must end before validation", "WARN")])
        )
    return out


def _kind_checks(df: DataFrame, s: SelfCheck, one: DataFrame) -> list[DataFrame]:
    c = F.col
    manual = lambda name, evidence, action: gate_rows(one, [Check(name, F.lit(False), F.lit(evidence), action, "MANUAL")])
    if s.kind == "text":
        if not s.text or s.text not in df.columns:
            return [gate_rows(one, [Check("text column", F.lit(False), F.lit(s.text or ""), "set the text column", "WARN")])]
        facts = profile.text_check(df, s.text)
        return [
            gate_rows(
                facts,
                [
                    Check("empty text", c("empty_texts") == 0, c("empty_texts"), "remove or justify", "WARN"),
                    Check("exact text duplicates", c("duplicate_texts") == 0, c("duplicate_texts"), "control copies before splitting", "WARN"),
                ],
            )
        ]
    if s.kind == "image":
        return [manual("image manifest", "path, label, group, split", "check files, hashes and group overlap")]
    if s.kind == "unsupervised":
        out = [manual("unsupervised evaluation plan", "stability and usefulness", "state how results are judged")]
        if len(profile.numeric_columns(df)) >= 2:
            ratio = profile.scale_ratio(df, limit=s.scale_limit)
            out.append(
                gate_rows(ratio, [Check("numeric scale difference", c("status") == "PASS", F.floor("scale_ratio"), "use a documented scaler", "WARN")])
            )
        return out
    return [manual("feature availability at prediction time", "human review", "mark post-outcome fields")]


def evidence_gate(checks: DataFrame, name: str = "check_name", passed: str = "passed") -> DataFrame:
    """One row: GREEN or YELLOW, number of checks and the failed names (a fixed, short list of checks)."""
    failed = F.array_sort(F.collect_list(F.when(~F.col(passed), F.col(name))))
    return checks.agg(
        F.when(F.bool_and(passed), "GREEN").otherwise("YELLOW").alias("decision"),
        F.count(F.lit(1)).alias("checks"),
        F.array_join(failed, ",").alias("failed"),
    )


def same_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Number of values found on one side only."""
    return count_rows(set_difference(left, right, "left", "right"), "differences")
