"""How many tokens each document has under a public tokenizer, and what each slice adds up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.encoding import count_tokens
from quern.llm.vocabulary import DEFAULT, FOLDER
from quern.operators.snapshots import clean_text, current_sections

#: The slice of documents that have no tag of a kind.
UNTAGGED = "untagged"


def token_budget(sections: DataFrame, fts: DataFrame, doc_tags: DataFrame, name: str = DEFAULT, folder: str = FOLDER) -> DataFrame:
    """``slice_kind, slice, repo_id, doc_id, n_docs, n_sections, tokens_l2, tokens_l3``.

    Kinds are ``document`` (the slice is the doc_id), ``repository``, ``language``
    and ``domain``; repo_id and doc_id are '' where a slice spans several. Sections
    are those of the last snapshot, each once; a section without text, or with null
    or empty text, counts with no tokens. Tags are compared in lower case without
    outer white space and once a document, so that a document with two domains is whole in both and a
    repeated tag adds nothing; documents without one are the slice ``untagged``.
    Repeated rows of ``fts`` count once (of different texts under one id, the one
    with more tokens). Tokens are added up by document before anything is joined to
    tags, so a hot repository or language shuffles one row a document.
    """
    counted = count_tokens(fts.where(F.col("id").isNotNull()), ["id"], {"tokens_l2": "body_l2", "tokens_l3": "body_l3"}, name, folder)
    by_id = counted.groupBy("id").agg(F.max("tokens_l2").alias("tokens_l2"), F.max("tokens_l3").alias("tokens_l3"))
    sizes = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_l2", "tokens_l3")]
    docs = current_sections(sections).join(by_id, "id", "left").groupBy("repo_id", "doc_id").agg(F.count("*").alias("n_sections"), *sizes)

    tag = F.lower(clean_text(F.col("tag")))
    tags = doc_tags.where(tag.startswith("lang-") | tag.startswith("dom-")).select(F.col("repo_id").alias("_repo"), F.col("doc_id").alias("_doc"), tag.alias("tag"))
    by_doc = tags.groupBy("_repo", "_doc").agg(F.collect_set("tag").alias("tags"))
    tagged = docs.join(by_doc, F.col("repo_id").eqNullSafe(F.col("_repo")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")

    def part(kind: str, value, repo=F.lit(""), doc=F.lit("")):
        return F.struct(F.lit(kind).alias("slice_kind"), value.alias("slice"), repo.alias("repo_id"), doc.alias("doc_id"))

    def by_tag(kind: str, prefix: str):
        all_tags = F.coalesce("tags", F.array().cast("array<string>"))
        own = F.transform(F.filter(all_tags, lambda t: t.startswith(prefix)), lambda t: F.substring(t, F.lit(len(prefix) + 1), F.length(t)))
        return F.transform(F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(UNTAGGED))), lambda s: part(kind, s))

    repo, doc = F.coalesce("repo_id", F.lit("")), F.coalesce("doc_id", F.lit(""))
    slices = F.concat(
        F.array(part("document", doc, repo, doc), part("repository", repo, repo)), by_tag("language", "lang-"), by_tag("domain", "dom-")
    )
    each = tagged.select(F.explode(slices).alias("s"), "n_sections", "tokens_l2", "tokens_l3").select("s.*", "n_sections", "tokens_l2", "tokens_l3")
    return each.groupBy("slice_kind", "slice", "repo_id", "doc_id").agg(
        F.count("*").alias("n_docs"), *[F.sum(c).alias(c) for c in ("n_sections", "tokens_l2", "tokens_l3")]
    )
