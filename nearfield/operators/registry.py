"""Catalog operators: token-overlap search, filters, validation and rendering over tables of entries."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise(text: str) -> str:
    return re.sub(r"[\s-]+", "_", text.strip().lower())


def tokens(text: Column) -> Column:
    """Distinct ``[a-z0-9_]+`` words of a lower-cased text, hyphens as underscores."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(text), "-", "_"), F.lit("[a-z0-9_]+"), F.lit(0)))


def list_entries(df: DataFrame, **filters: str) -> DataFrame:
    """Entries whose normalised columns contain the normalised filters (R7, P11); empty filters are ignored."""
    for column, value in filters.items():
        if value:
            df = df.where(F.contains(F.regexp_replace(F.lower(F.col(column).cast("string")), r"[\s-]+", "_"), F.lit(normalise(value))))
    return df


def search(df: DataFrame, query: str, boosts: Sequence[tuple[Column, int]] = (), inputs: Sequence[str] = (), k: int = 8, text: str = "text", tie: str | None = None) -> DataFrame:
    """Ranked search (R2-R6): shared tokens, plus points for each true boost, plus two per supplied input.

    Adds ``score`` and ``missing_inputs`` (U6).  With a non-empty query, scores of zero and less are dropped.
    At least one and at most ``k`` rows; ties go to ``tie`` (descending) and then to the id.
    """
    wanted = sorted(set(re.findall("[a-z0-9_]+", query.lower().replace("-", "_"))))
    score = F.size(F.array_intersect(tokens(F.col(text)), F.array(*map(F.lit, wanted)).cast("array<string>")))
    for condition, points in boosts:
        score = score + F.when(condition, points).otherwise(0)
    given = F.array(*[F.lit(normalise(x)) for x in inputs]).cast("array<string>")
    if inputs:
        score = score + 2 * F.size(F.array_intersect(F.col("inputs"), given))
    out = df.withColumn("score", score).withColumn("missing_inputs", F.array_sort(F.array_except("inputs", given)))
    if wanted:
        out = out.where("score > 0")
    order = [F.desc("score"), *([F.desc_nulls_last(tie)] if tie else []), F.asc("id")]
    return out.orderBy(*order).limit(max(1, k))


#: Words that say that data are large (fixed values).
SIZE_WORDS = ("million", "millions", "billion", "billions", "large", "huge", "massive")


def search_strategies(df: DataFrame, query: str, kind: str = "", large: bool = False, exact: bool = False, k: int = 8, shape: str = "") -> DataFrame:
    """Four points for the kind, two for not being exact at large scale, two for being exact when asked.

    With ``shape`` four more for entries of that data shape in their text; words of size in the query ask for large scale.
    """
    boosts = []
    large = large or bool(set(re.findall("[a-z]+", query.lower())) & set(SIZE_WORDS))
    if shape:
        boosts.append((F.contains(F.lower("text"), F.lit(normalise(shape))), 4))
    if kind:
        boosts.append((F.contains(F.col("kind"), F.lit(normalise(kind))), 4))
    if large:
        boosts.append((F.col("exactness") != "exact", 2))
    if exact:
        boosts.append((F.col("exactness") == "exact", 2))
    return search(df.where("catalog = 'strategy'"), query, boosts, k=k)


def search_definitions(df: DataFrame, query: str, data_type: str = "", inputs: Sequence[str] = (), k: int = 8) -> DataFrame:
    """R2: three points for the data type; entries of another type lose three and must share seven words and more; entries without a shared word are dropped."""
    wanted = sorted(set(re.findall("[a-z0-9_]+", query.lower().replace("-", "_"))))
    shared = F.size(F.array_intersect(tokens(F.col("text")), F.array(*map(F.lit, wanted)).cast("array<string>")))
    if not data_type:
        return search(df.where(shared > 0) if wanted else df, query, inputs=inputs, k=k)
    fits = F.contains(F.col("kind"), F.lit(normalise(data_type)))
    return search(df.where((shared > 0) & (fits | (shared >= 7))), query, [(fits, 3), (~fits, -3)], inputs, k)


def search_operating_points(df: DataFrame, query: str, data_type: str = "", axis: str = "", k: int = 8) -> DataFrame:
    """Four points each for the data type in the text and for the axis in the held-out unit."""
    boosts = [(F.contains(F.lower("text"), F.lit(normalise(data_type))), 4)] if data_type else []
    boosts += [(F.contains(F.col("kind"), F.lit(normalise(axis))), 4)] if axis else []
    return search(df, query, boosts, k=k)


def _field_search(df: DataFrame, query: str, boosts: list, fields: Sequence[str], per_field: int, tie: str, k: int) -> DataFrame:
    given = F.array(*[F.lit(normalise(f)) for f in fields]).cast("array<string>")
    points = [(F.size(F.array_intersect("inputs", given)) >= n, per_field) for n in range(1, len(set(fields)) + 1)]
    return search(df, query, [*boosts, *points], k=k, tie=tie)


def search_datasets(df: DataFrame, query: str, domain: str = "", data_type: str = "", family: str = "", fields: Sequence[str] = (), k: int = 8) -> DataFrame:
    """R5 over entries with ``domain, kind, family, inputs, active``: five points for the domain, four each for type and family, two a field; active ones first among equals."""
    asked = ((domain, "domain", 5), (data_type, "kind", 4), (family, "family", 4))
    return _field_search(df, query, [(F.contains(F.col(c), F.lit(normalise(v))), n) for v, c, n in asked if v], fields, 2, "active", k)


def search_memories(df: DataFrame, query: str, domain: str = "", data_type: str = "", family: str = "", model: str = "", tags: Sequence[str] = (), tie: str = "active", k: int = 8) -> DataFrame:
    """Five points for the domain, four for the type, five for the family, six for the model, three a tag; high priority first among equals."""
    asked = ((domain, "domain", 5), (data_type, "kind", 4), (family, "family", 5), (model, "model", 6))
    return _field_search(df, query, [(F.contains(F.col(c), F.lit(normalise(v))), n) for v, c, n in asked if v], tags, 3, tie, k)


def forbidden(df: DataFrame, columns: Sequence[str], paths: Sequence[str]) -> DataFrame:
    """``id, found``, the forbidden texts that stand in an entry's columns; entries without any are left out."""
    held = [F.when(F.coalesce(*[F.when(F.contains(F.col(c), F.lit(p)), True) for c in columns], F.lit(False)), F.lit(p)) for p in paths]
    return df.select("id", F.array_compact(F.array(*held)).alias("found")).where(F.size("found") > 0)


def validate(df: DataFrame, required: Sequence[str], statuses: Sequence[str] = (), status: str = "status") -> DataFrame:
    """One row per entry: ``id, errors``, the required columns that are missing, null or empty, and unknown statuses."""
    def problem(c: str) -> Column:
        if c not in df.columns:
            return F.lit(f"missing {c}")
        kind = dict(df.dtypes)[c]
        empty = F.size(c) <= 0 if kind.startswith(("array", "map")) else F.trim(F.col(c).cast("string")) == ""
        return F.when(F.col(c).isNull() | empty, F.lit(f"empty {c}"))

    parts = [problem(c) for c in required]
    if statuses and status in df.columns:
        parts.append(F.when(~F.coalesce(F.col(status).isin(*statuses), F.lit(False)), F.lit(f"unknown {status}")))
    return df.select("id", F.array_compact(F.array(*parts).cast("array<string>")).alias("errors"))


def render(row: dict) -> str:
    """An entry as Markdown; lists become bullet points, empty fields are left out."""
    lines = [f"# {row.get('id', '')}"]
    for key, value in row.items():
        if key == "id" or value in (None, "", []):
            continue
        lines.append(f"\n## {key.replace('_', ' ').capitalize()}\n")
        lines += [f"- {v}" for v in value] if isinstance(value, (list, tuple)) else [str(value)]
    return "\n".join(lines) + "\n"


def flatten_provenance(records: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Several array columns of sources as rows ``id, role, place, source``; ``columns`` maps a column to its role."""
    out = None
    for column, role in columns.items():
        part = records.select("id", F.lit(role).alias("role"), F.posexplode(column).alias("place", "source"))
        out = part if out is None else out.unionByName(part)
    return out


def provenance_contract(tables: dict[str, DataFrame]) -> DataFrame:
    """R13 per finding: does it have an id, a status, a checkpoint with a source and a data source; ``complete`` if all.

    ``tables`` come from :func:`nearfield.operators.nested.flatten`; rows are matched along their keys, so
    findings without an id, and several of one id, keep what is theirs.
    """
    blank = F.length(F.trim(F.coalesce("source_url_or_repo", F.lit("")))) == 0
    models = tables["model"].select("pk", F.col("parent_pk").alias("finding"))
    # a checkpoint's key begins with that of its model, however deep it stands
    with_source = tables["checkpoint"].where(~blank).select(F.regexp_extract("pk", r"^(.*/m\d+)/c\d+$", 1).alias("pk")).distinct()
    has_checkpoint = models.join(with_source, "pk", "left_semi").select(F.col("finding").alias("pk")).distinct().withColumn("has_checkpoint", F.lit(True))
    has_data = tables["source"].where("role = 'dataset_sources'").select(F.col("parent_pk").alias("pk")).distinct().withColumn("has_dataset", F.lit(True))
    false = F.lit(False)
    out = tables["finding"].join(has_checkpoint, "pk", "left").join(has_data, "pk", "left").select(
        "delivery_id",
        "pk",
        "finding_id",
        F.coalesce(F.length(F.trim("finding_id")) > 0, false).alias("has_id"),
        F.coalesce(F.length(F.trim("status")) > 0, false).alias("has_status"),
        F.coalesce("has_checkpoint", false).alias("has_checkpoint"),
        F.coalesce("has_dataset", false).alias("has_dataset"),
    )
    return out.withColumn("complete", F.col("has_id") & F.col("has_status") & F.col("has_checkpoint") & F.col("has_dataset"))


def crosstab_status(df: DataFrame, axis: str, status: str, statuses: Sequence[str], support: str) -> DataFrame:
    """Counts of each status per axis and the share of ``support`` among all."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    return df.groupBy(axis).agg(F.count("*").alias("n"), *counts, (F.count_if(F.col(status) == support) / F.count("*")).alias("support_fraction"))


def search_findings(findings: DataFrame, query: str, columns: Sequence[str], k: int = 10) -> DataFrame:
    """Findings by the number of query tokens in their columns, then by id; ``k`` between 1 and 50; none without a hit."""
    wanted = F.array(*[F.lit(t) for t in sorted(set(re.findall("[a-z0-9_]+", query.lower().replace("-", "_"))))]).cast("array<string>")
    text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    words = F.array_distinct(F.concat(tokens(text), F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))))
    hits = findings.withColumn("hits", F.size(F.array_intersect(words, wanted))).where("hits > 0")
    return hits.orderBy(F.desc("hits"), "finding_id").limit(max(1, min(50, k)))


def next_moves(findings: DataFrame, rules: dict[str, str], default: str = "review") -> DataFrame:
    """The next move of each finding by its status; unknown or missing statuses get the default."""
    move = F.lit(default)
    for status, action in rules.items():
        move = F.when(F.lower(F.trim("status")) == status.lower(), action).otherwise(move)
    return findings.withColumn("next_move", move)
