"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

``deduplicate`` takes SimHash links with them: documents whose fingerprints differ in three bits or fewer belong
together as well, and a group is what links of either kind connect.

Documents are dealt to nodes by the covering masks over their SimHash fingerprints, which bring together all within three
bits, and then by chosen-path trees, for those whose fingerprints differ more. All members of a node
are linked by their whole sets, so that no pair below 0.8 is ever linked.

Defined cases: as in ``chosen_path``, but null and blank texts, whose sets are empty, are one class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm import chosen_path, simhash
from tripleweave.llm.components import components

SHINGLE = 5


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, component_id)`` per document; the component's is the smallest id reachable."""
    found = chosen_path.near_duplicates(docs, id_col, text_col, SHINGLE, link_empty=True, fingerprints=True)
    return found.select("doc_id", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose group, by SimHash links and near copies, has a smaller id; documents
    without id stay."""
    found = [near_copies(docs, id_col, text_col), simhash.near_duplicates(docs, id_col, text_col)]
    links = [df.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")) for df in found]
    # A document without id, or a component of such documents alone, is no end of a link.
    roots = components(links[0].unionByName(links[1]).dropna())
    copies = roots.filter("node <> root").select(F.col("node").alias(id_col))
    return docs.join(copies, id_col, "left_anti")
