"""Catalog of systems: what the manuals say about each chapter-section code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hangarflow.functions.codes import ata_from_filename_loose
from hangarflow.operators.documents import (
    WARNING_TAGS,
    dmc_children_ata,
    lowered,
    raw_text,
    strings_of,
)

# --- fixed values: tags, limits, patterns and symptom words -------------------
NAME_TAGS = ["title", "dmTitle", "techName", "infoName"]
KEYWORD_TAGS = ["title", "para", "description", "warning", "caution"]
DESCRIPTION_TAGS = ["para", "description"]
CREW_ALERT = r"[A-Z]{2,}\s+[A-Z/]+(?:\s+[A-Z]+)?"
KEYWORD = r"(?U)\b[a-z]{4,}\b"
KEYWORDS_PER_TAG = 10
SYMPTOMS = [
    "failure",
    "fault",
    "leak",
    "inoperative",
    "malfunction",
    "abnormal",
    "warning",
    "error",
    "defect",
]
SAVED_KEYWORDS, SAVED_WARNINGS, SAVED_DESCRIPTIONS = 50, 20, 10
TRAINING_DESCRIPTIONS = 5
# --- end of fixed values --------------------------------------------------------

NAME, KEYWORD_KIND, WARNING, DESCRIPTION = "name", "keyword", "warning", "description"
# Order of the kinds inside a training text.
KIND_ORDER = [NAME, KEYWORD_KIND, WARNING, DESCRIPTION]


def _longer_than(text: Column, low: int, high: int) -> Column:
    return (F.length(text) > low) & (F.length(text) < high)


def catalog_code(parsed: DataFrame) -> DataFrame:
    """Add ``ata04`` from the path, else from the data-module code; drop the rest."""
    code = F.coalesce(
        ata_from_filename_loose(F.col("filename")), dmc_children_ata(F.col("elements"))
    )
    return parsed.withColumn("ata04", code).where(F.col("ata04").isNotNull())


def _raw_of(tags: list[str]) -> Column:
    wanted = F.filter("_texts", lambda t: t["name"].isin(lowered(tags)))
    return F.transform(wanted, lambda t: t["raw"])


def _system_name() -> Column:
    """First tag of each name tag, taken in tag order, when its length is plausible."""
    firsts = F.array_compact(
        F.array(*[F.try_element_at(_raw_of([tag]), F.lit(1)) for tag in NAME_TAGS])
    )
    return F.try_element_at(F.filter(firsts, lambda n: _longer_than(n, 5, 200)), F.lit(1))


def _keywords(per_tag: int) -> Column:
    short = F.filter(_raw_of(KEYWORD_TAGS), lambda t: _longer_than(t, 0, 100))
    words = F.transform(
        short,
        lambda t: F.slice(
            F.regexp_extract_all(F.lower(t), F.lit(KEYWORD), F.lit(0)), 1, per_tag
        ),
    )
    return F.array_distinct(F.flatten(words))


def _warnings() -> Column:
    tagged = F.filter(_raw_of(WARNING_TAGS), lambda t: _longer_than(t, 0, 200))
    whole = F.array_join(strings_of(F.element_at("elements", 1)), "")
    alerts = F.filter(
        F.regexp_extract_all(whole, F.lit(CREW_ALERT), F.lit(0)),
        lambda m: _longer_than(m, 5, 50),
    )
    return F.array_distinct(F.concat(tagged, alerts))


def _descriptions() -> Column:
    symptom = "|".join(SYMPTOMS)
    return F.array_distinct(
        F.filter(
            _raw_of(DESCRIPTION_TAGS),
            lambda t: _longer_than(t, 20, 150) & F.lower(t).rlike(symptom),
        )
    )


def catalog_items(parsed: DataFrame, keywords_per_tag: int = KEYWORDS_PER_TAG) -> DataFrame:
    """Long catalog of distinct ``(ata04, kind, value, name_file)`` rows.

    ``name_file`` tells which file a name comes from and is NULL for the other
    kinds. A document yields all its values in one pass; the only shuffle is
    the distinct, which hashes before and after it and is keyed by the value,
    so a code that owns most documents spreads over all tasks.
    """
    used = lowered([*NAME_TAGS, *KEYWORD_TAGS, *WARNING_TAGS])
    texts = F.transform(
        F.filter("elements", lambda e: e["name"].isin(used)),
        lambda e: F.struct(e["name"].alias("name"), raw_text(strings_of(e)).alias("raw")),
    )

    def items(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.concat(
        items(NAME, F.array_compact(F.array(_system_name()))),
        items(KEYWORD_KIND, _keywords(keywords_per_tag)),
        items(WARNING, _warnings()),
        items(DESCRIPTION, _descriptions()),
    )
    return (
        catalog_code(parsed)
        .withColumn("_texts", texts)
        .select("ata04", "filename", F.explode(found).alias("item"))
        .select(
            "ata04",
            "item.kind",
            "item.value",
            F.when(F.col("item.kind") == NAME, F.col("filename")).alias("name_file"),
        )
        .distinct()
    )


def catalog_codes(parsed: DataFrame) -> DataFrame:
    """The codes that have at least one document, even one without any value."""
    return catalog_code(parsed).select("ata04").distinct()


def system_names(items: DataFrame) -> DataFrame:
    """The name found in the first file of each code."""
    return (
        items.where(F.col("kind") == NAME)
        .groupBy("ata04")
        .agg(F.min_by("value", "name_file").alias("system_name"))
    )


def values_of(items: DataFrame, kind: str, alias: str) -> DataFrame:
    """Distinct values of one kind, one row each."""
    return items.where(F.col("kind") == kind).select("ata04", F.col("value").alias(alias))


def first_values(items: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The alphabetically first values per code and kind, up to the cap of the kind.

    The rank filter is applied before the shuffle as well, so no task sees more
    than the cap per code, kind and input split.
    """
    rank = F.row_number().over(Window.partitionBy("ata04", "kind").orderBy("value"))
    allowed = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in caps.items()])
    return (
        items.where(F.col("kind").isin(list(caps)))
        .withColumn("rank", rank)
        .where(F.col("rank") <= max(caps.values()))
        .where(F.col("rank") <= allowed)
    )


def saved_catalog(
    items: DataFrame,
    codes: DataFrame | None = None,
    caps: dict[str, int] | None = None,
) -> DataFrame:
    """One row per code: name and alphabetical, length-limited value lists."""
    caps = caps or {
        KEYWORD_KIND: SAVED_KEYWORDS,
        WARNING: SAVED_WARNINGS,
        DESCRIPTION: SAVED_DESCRIPTIONS,
    }

    def listed(kind: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("value"))))

    lists = (
        first_values(items, caps)
        .groupBy("ata04")
        .agg(
            listed(KEYWORD_KIND).alias("keywords"),
            listed(WARNING).alias("warnings"),
            listed(DESCRIPTION).alias("sample_descriptions"),
        )
    )
    names = system_names(items)
    # One row per code on every side.
    base = names.join(lists, "ata04", "full")
    if codes is not None:
        base = codes.join(base, "ata04", "left")
    empty = F.array().cast("array<string>")
    return base.select(
        "ata04",
        F.coalesce("system_name", F.lit("")).alias("system_name"),
        F.coalesce("keywords", empty).alias("keywords"),
        F.coalesce("warnings", empty).alias("warnings"),
        F.coalesce("sample_descriptions", empty).alias("sample_descriptions"),
    )


def training_lines(items: DataFrame, descriptions: int = TRAINING_DESCRIPTIONS) -> DataFrame:
    """The training text of each code as ordered lines ``(ata04, part, line_order, text)``.

    The text of a code is its lines joined by blanks in ``(part, line_order)``
    order: the name, all keywords, all warnings, and the first descriptions. Keywords and warnings are sets without an order of their own;
    they are ordered by MD5, which cuts into equal ranges however the values
    are spelled. Nothing is gathered per code.
    """
    name = system_names(items).select(
        "ata04", F.lit(NAME).alias("kind"), F.col("system_name").alias("value")
    )
    described = first_values(items, {DESCRIPTION: descriptions}).select(
        "ata04", "kind", "value"
    )
    sets = items.where(F.col("kind").isin(KEYWORD_KIND, WARNING)).select("ata04", "kind", "value")
    part = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind")).cast("int")
    return name.unionByName(sets).unionByName(described).select(
        "ata04",
        part.alias("part"),
        F.md5("value").alias("line_order"),
        F.lower("value").alias("text"),
    )


def catalog_info(codes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog entry for each requested code, NULL columns where there is none."""
    return codes.join(catalog, "ata04", "left")


def search_by_keyword(catalog: DataFrame, keyword: str) -> DataFrame:
    """Entries whose name, a keyword or a warning contains the word, any case."""
    needle = keyword.lower()

    def hit(values: str) -> Column:
        return F.exists(values, lambda v: F.contains(F.lower(v), F.lit(needle)))

    return catalog.where(
        F.contains(F.lower("system_name"), F.lit(needle)) | hit("keywords") | hit("warnings")
    )


def _field_values(catalog: DataFrame) -> DataFrame:
    """Distinct ``(ata04, field, value)`` of names, keywords and warnings, in lower case."""
    name = catalog.select("ata04", F.lit("system_name").alias("field"), F.col("system_name").alias("value"))
    parts = [name] + [
        catalog.select("ata04", F.lit(field).alias("field"), F.explode(field).alias("value"))
        for field in ("keywords", "warnings")
    ]
    values = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return values.where(F.col("value").isNotNull() & (F.col("value") != "")).select(
        "ata04", "field", F.lower("value").alias("value")
    ).distinct()


def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of ``n`` characters (the whole text if it is shorter)."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))))


def search_keywords(catalog: DataFrame, keywords: DataFrame, gram: int = 3) -> DataFrame:
    """``(keyword, ata04, field)`` for every keyword of a table found in a name, keyword or warning, any case.

    An index of the values' substrings of 1 to ``gram`` characters is met by one
    key per keyword: its rarest ``gram``-character substring, or the keyword itself
    when it is shorter. Every value that contains the keyword holds that key, so
    the join finds all of them; ``contains`` then confirms each candidate. Each
    keyword is one row of the join, however many keywords there are.
    """
    values = _field_values(catalog)
    index = values.select(
        "ata04", "field", "value", F.explode(F.flatten(F.array(*[_grams(F.col("value"), n) for n in range(1, gram + 1)]))).alias("key")
    ).distinct()
    counts = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    asked = keywords.select(F.lower("keyword").alias("keyword")).where(F.length("keyword") > 0).distinct()
    keyed = asked.select("keyword", F.explode(_grams(F.col("keyword"), gram)).alias("key"))
    rarest = (
        keyed.join(counts, "key", "left")
        .groupBy("keyword")
        .agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("key"))
    )
    found = rarest.join(index, "key").where(F.contains("value", "keyword"))
    return found.select("keyword", "ata04", "field").distinct()


def catalog_statistics(catalog: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Entry, keyword, warning, sample and vocabulary counts in one row."""

    def total(values: str) -> Column:
        return F.coalesce(F.sum(F.size(values)), F.lit(0)).cast("long")

    vocabulary_size = vocabulary.agg(F.count(F.lit(1))).scalar()
    return catalog.agg(
        F.count(F.lit(1)).alias("total_atas"),
        total("keywords").alias("total_keywords"),
        total("warnings").alias("total_warnings"),
        total("sample_descriptions").alias("total_sample_descriptions"),
    ).withColumn("vocabulary_size", vocabulary_size)
