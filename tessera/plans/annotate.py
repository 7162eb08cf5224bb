"""Deterministic annotations of plain documents, standing in for a parser, a mention detector and an entity linker.

Tokens are runs of [a-z0-9]; arcs chain them, with a root loop at the first; mentions are tokens of six or more characters;
entities are their distinct words, with a number from an MD5, linked unless that is divisible by 3; relations join
entities of consecutive mentions. Whole texts are annotated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import arrays as A

#: Characters of fixed windows and of the step between them.
WIDE, STEP = 1000, 800
#: Characters of a word that is a mention.
LONG = 6


_SECTIONS = (
    "parse_trees array<struct<head:string,h_idx:bigint,child:string,t_idx:bigint,r:string>>, "
    "mentions array<struct<mention_id:bigint,name:string,type:string,token_index:array<bigint>>>, "
    "vertexSet array<array<struct<mention_id:bigint,wikipedia_id:bigint,wikidata_id:string>>>, "
    "ent_relation array<struct<h_idx:bigint,t_idx:bigint,r:string,score:double>>"
)


def _annotated(batch: pa.RecordBatch) -> pa.RecordBatch:
    words, row, at = A.spread(batch.column("w"))
    rows, size = len(batch), A.lengths(batch.column("w"))
    struct = lambda **x: pa.StructArray.from_arrays(list(x.values()), list(x))
    i64 = lambda x: pa.array(x, pa.int64())
    head = words.take(pa.array(np.arange(len(row)) - (at > 0)))
    trees = struct(head=head, h_idx=i64(np.maximum(at - 1, 0)), child=words, t_idx=i64(at), r=pa.array(["ROOT", "next"]).take(pa.array((at > 0).astype(int))))

    men = np.flatnonzero(pc.utf8_length(words).to_numpy(zero_copy_only=False) >= LONG)
    coded = words.take(pa.array(men)).dictionary_encode()
    m_row, ids = row[men], at[men]
    entities = A.Ids(m_row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    entity = entities.find(m_row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    e_row = m_row[entities.at]
    n_m, n_e = np.bincount(m_row, minlength=rows), np.bincount(e_row, minlength=rows)
    place = entity - A.first_of(n_e)[m_row]
    mentions = struct(mention_id=i64(ids), name=words.take(pa.array(men)), type=pa.array(["X"] * len(men), pa.string()), token_index=A.nested(np.ones(len(men), dtype=np.int64), i64(ids)))

    wiki = np.array([int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in coded.dictionary.to_pylist()], dtype=np.int64)
    order = np.argsort(entity, kind="stable")
    own = wiki[coded.indices.to_numpy(zero_copy_only=False)[order]] if len(order) else wiki[:0]
    known = np.array([f"Q{x}" if x % 3 else "" for x in own.tolist()], dtype=object)
    inner = struct(mention_id=i64(ids[order]), wikipedia_id=i64(own), wikidata_id=pa.array(known, pa.string()))
    vertices = A.nested(n_e, A.nested(np.bincount(entity, minlength=len(e_row)), inner))

    near = np.flatnonzero((m_row[1:] == m_row[:-1]) & (place[1:] != place[:-1]))
    rel = struct(h_idx=i64(place[near]), t_idx=i64(place[near + 1]), r=pa.array(["P1"] * len(near), pa.string()), score=pa.nulls(len(near), pa.float64()))
    cols = [batch.column("doc"), A.nested(size, trees), A.nested(n_m, mentions), vertices, A.nested(np.bincount(m_row[near], minlength=rows), rel)]
    return pa.RecordBatch.from_arrays(cols, ["doc", "parse_trees", "mentions", "vertexSet", "ent_relation"])


def annotated(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> A.Rows:
    """``sections``, for operators that go on in the same pass."""

    def step(batch):
        for part in A.slices(batch, "w"):
            yield _annotated(part)

    words = (F.col(doc).alias("doc"), T.words(text).alias("w"))
    return A.Rows(docs.select(doc, text), words, "size(w) > 0", (step,), f"doc {dict(docs.dtypes)[doc]}, {_SECTIONS}")


def sections(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, parse_trees, mentions, vertexSet, ent_relation) of every document with a word. A real parser is a model call on
    rows, too, so this stands in as one: rows come and go in Arrow batches."""
    return annotated(docs, doc, text).frame()


def neighbours(docs: DataFrame) -> DataFrame:
    """(pair, i, j): every document with the next one of its language and source."""
    w = Window.partitionBy("lang", "source").orderBy("doc_id")
    return docs.select(F.col("doc_id").alias("pair"), F.col("doc_id").alias("i"), F.lead("doc_id").over(w).alias("j")).where("j is not null")


def fixed_windows(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, window_id, start, end) of WIDE characters every STEP."""
    k = F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / STEP).cast("int")))
    return docs.select(F.col(doc).alias("doc"), k.alias("window_id")).select("doc", "window_id", (F.col("window_id") * STEP).alias("start"), (F.col("window_id") * STEP + WIDE).alias("end"))


def scores(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """(event, system, x, y): mean price and mean order total by market segment and nation."""
    j = lineitem.join(orders, lineitem["l_orderkey"] == orders["o_orderkey"]).join(customer, orders["o_custkey"] == customer["c_custkey"]).join(F.broadcast(nation), customer["c_nationkey"] == nation["n_nationkey"])
    return j.groupBy(F.col("c_mktsegment").alias("event"), F.col("n_name").alias("system")).agg(F.avg("l_extendedprice").alias("x"), F.avg("o_totalprice").alias("y"))
