"""The federated catalogue: repositories, documents, tags, counts and digests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import natural_key, token_estimate
from quern.operators.snapshots import latest_rows

#: The kinds of repositories.
KINDS = ("kb", "ba", "dev", "tester")


#: How the titles of generated documents end.
PLAN_TITLE, TESTS_TITLE = "— plan", "— tests"


def kinds(values: Iterable[str]) -> list[str]:
    """Which of the kinds are asked for, in alphabetical order; anything else is an error, and nothing asks for nothing."""
    place = {kind: i for i, kind in enumerate(sorted(KINDS))}
    asked = [False] * len(place)
    for value in values:
        if (name := value.strip().casefold()) not in place:
            raise ValueError(f"there is no kind {value!r} of repository, only {', '.join(place)}")
        asked[place[name]] = True
    return [kind for kind, i in place.items() if asked[i]]


def current_docs(docs: DataFrame) -> DataFrame:
    """One row a document; of repeated ones the last in order."""
    columns = [c for c in docs.columns if c not in ("repo_id", "doc_id", "ord")]
    return latest_rows(docs, ["repo_id", "doc_id"], "ord", columns)


def inferred_kinds(docs: DataFrame) -> DataFrame:
    """``repo_id, inferred``: what a repository's documents tell of its kind; the first rule that holds wins. Tags are taken as they are written."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))

    def has(*names: str) -> Column:
        return F.forall(F.array(*map(F.lit, names)), lambda n: F.array_contains(tags, n))

    rule = (
        F.when(F.col("title").endswith(TESTS_TITLE) & has("test", "generated"), 4)
        .when(F.col("title").endswith(PLAN_TITLE) & has("plan", "generated"), 3)
        .when((F.col("doc_id").endswith("-code") | F.col("doc_id").endswith("-svc")) & has("code"), 2)
        .otherwise(1)
    )
    names = F.create_map(*[F.lit(x) for pair in ((4, "tester"), (3, "ba"), (2, "dev"), (1, "kb")) for x in pair])
    return docs.groupBy("repo_id").agg(F.max(rule).alias("rule")).select("repo_id", F.element_at(names, F.col("rule")).alias("inferred"))


def current_repos(repos: DataFrame, docs: DataFrame) -> DataFrame:
    """``repo_id, kind, published_at, fingerprint`` of the last snapshot; a kind that isn't recorded, or isn't one, is inferred."""
    last = repos.select(F.max("snapshot_no")).scalar()
    rows = latest_rows(repos.where(F.col("snapshot_no") == last), ["repo_id"], "delivered_at", ["kind", "published_at", "fingerprint"])
    recorded = F.lower(F.trim("kind"))
    kind = F.coalesce(F.when(recorded.isin(*KINDS), recorded), "inferred", F.lit("kb"))
    return rows.join(inferred_kinds(docs), "repo_id", "left").select("repo_id", kind.alias("kind"), "published_at", "fingerprint")


def of_kinds(rows: DataFrame, repos: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of repositories of some kinds."""
    return rows.join(repos.where(F.col("kind").isin(kinds(wanted))).select("repo_id"), "repo_id", "left_semi")


def tag_vocabulary(docs: DataFrame) -> DataFrame:
    """``key, tag, docs``: every tag in lower case, how it is spelt where it first stands, and how many documents have it."""
    each = docs.select("repo_id", "doc_id", "ord", F.posexplode("tags").alias("at", "raw")).where(F.trim("raw") != "")
    spelt = each.withColumn("tag", F.trim("raw")).withColumn("key", F.lower("tag"))
    per_doc = spelt.groupBy("key", "repo_id", "doc_id").agg(F.min(F.struct("ord", "repo_id", "doc_id", "at", "tag")).alias("first"))
    return per_doc.groupBy("key").agg(F.min("first").getField("tag").alias("tag"), F.count("*").alias("docs"))


def doc_stats(sections: DataFrame, fts: DataFrame) -> DataFrame:
    """``repo_id, doc_id, sections, l1, l2, l3, saving``: estimated tokens of each layer, and what the condensed one saves in percent."""
    texts = fts.dropDuplicates(["id"]).select(
        "id", token_estimate(F.concat_ws("\n", "title", "summary")).alias("l1"), token_estimate(F.col("body_l2")).alias("l2"), token_estimate(F.col("body_l3")).alias("l3")
    )
    sums = sections.join(texts, "id").groupBy("repo_id", "doc_id").agg(F.count("*").alias("sections"), *[F.sum(c).alias(c) for c in ("l1", "l2", "l3")])
    saving = F.when(F.col("l3") == 0, 0.0).otherwise(100.0 * (1 - F.col("l2") / F.col("l3")))
    return sums.withColumn("saving", F.round(saving, 6))


def store_stats(docs: DataFrame, sections: DataFrame, repos: DataFrame) -> DataFrame:
    """``measure, kind, n``: repositories, documents by kind of repository, and sections."""
    total = sections.agg(F.count("*").alias("n")).select(F.lit("sections").alias("measure"), F.lit("").alias("kind"), "n")
    held = repos.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("repos").alias("measure"), "kind", "n")
    by_kind = docs.join(repos, "repo_id", "left").groupBy(F.coalesce("kind", F.lit("")).alias("kind")).agg(F.count("*").alias("n")).select(F.lit("docs").alias("measure"), "kind", "n")
    return total.unionByName(held).unionByName(by_kind)


def counts_by(rows: DataFrame, key: str, column: str, values: list[str], done: list[str]) -> DataFrame:
    """``key``, a count for each value, ``total`` and ``pct``, the share of ``done`` values, rounded half to even."""
    finished = F.count_if(F.col(column).isin(done))
    pct = F.bround(100.0 * finished / F.count("*")).cast("long")
    return rows.groupBy(key).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v.lower()}") for v in values], F.count("*").alias("total"), pct.alias("pct"))


def without_machine_sections(rows: DataFrame, docs: DataFrame, section: str = "section_id") -> DataFrame:
    """Rows of sections that people write: not of histories (``hist.…``), nor of documents tagged as generated."""
    made = docs.where(F.array_contains("tags", "generated")).select("repo_id", "doc_id").distinct()
    return rows.where(~F.col(section).startswith("hist.")).join(made, ["repo_id", "doc_id"], "left_anti")


def held_twice(docs: DataFrame) -> DataFrame:
    """``doc_id, holders`` of ids that more than one repository has."""
    held = docs.select("doc_id", "repo_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("repo_id")).alias("holders"))
    return held.where("n > 1").select("doc_id", F.array_join("holders", ",").alias("holders"))


def parent_of(asked: DataFrame, known: DataFrame, keys: list[str], child: str, entry: str) -> DataFrame:
    """Each asked id with ``parent``, the entry that is its longest proper prefix cut at ``.`` or ``-``, or null.

    All prefixes are joined by equality instead of comparing every id with every entry.
    """
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(child), F.lit(1))), lambda i: F.substring(F.col(child), i, F.lit(1)).isin(".", "-"))
    prefixes = F.transform(cuts, lambda i: F.substring(F.col(child), F.lit(1), i - 1))
    each = asked.select(*keys, child, F.explode_outer(prefixes).alias("_prefix"))
    found = each.join(known.select(*keys, F.col(entry).alias("_prefix"), F.lit(True).alias("_known")).distinct(), [*keys, "_prefix"], "left")
    longest = F.max(F.when(F.col("_known"), F.struct(F.char_length("_prefix").alias("n"), F.col("_prefix").alias("p"))))
    return found.groupBy(*keys, child).agg(longest.getField("p").alias("parent"))


def reading_order(section_id: str = "section_id") -> list[Column]:
    """Sections in the order of their numbers, those without a number first."""
    return [F.transform(natural_key(F.col(section_id)), lambda x: F.coalesce(x, F.lit(-1))), F.col(section_id)]


def neighbours_in_doc(sections: DataFrame) -> DataFrame:
    """Each section with ``prev_id`` and ``next_id`` in its document."""
    w = Window.partitionBy("repo_id", "doc_id").orderBy(*reading_order())
    return sections.select("repo_id", "doc_id", "section_id", F.lag("section_id").over(w).alias("prev_id"), F.lead("section_id").over(w).alias("next_id"))


def chapter_starts(sections: DataFrame) -> DataFrame:
    """Sections at which a document's file changes, of documents of more than one file."""
    w = Window.partitionBy("repo_id", "doc_id").orderBy(*reading_order())
    whole = Window.partitionBy("repo_id", "doc_id")
    moved = sections.select("repo_id", "doc_id", "section_id", "file", F.lag("file").over(w).alias("_before"), F.min("file").over(whole).alias("_a"), F.max("file").over(whole).alias("_b"))
    return moved.where((F.col("_a") != F.col("_b")) & ~F.col("file").eqNullSafe(F.col("_before"))).select("repo_id", "doc_id", "section_id", "file")


def tree_digest(entries: DataFrame, group: str, path: Column, digest: Column, depth: int = 3) -> DataFrame:
    """``group, entries, digest``: one SHA-256 for all (path, digest) entries of each group, whatever their order.

    A tree of hashes: entries are put into buckets by the hash of their path, each
    bucket's sorted entries are hashed, and the sorted buckets again, so that a group
    of any size is never in one task as a whole.
    """
    row = F.concat(path, F.unhex(F.lit("00")).cast("string"), digest, F.unhex(F.lit("00")).cast("string"))
    rows = entries.select(F.col(group), F.substring(F.sha2(path, 256), 1, depth).alias("_bucket"), row.alias("_row"))
    buckets = rows.groupBy(group, "_bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("_row")), ""), 256).alias("_sha"))
    line = F.concat("_bucket", F.lit(":"), "_sha")
    return buckets.groupBy(group).agg(F.sum("n").alias("entries"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))
