"""Samples that arrive as files, some of them twice, become graphs batch by batch."""

import json

from pyspark.sql import functions as F

from tessera.streaming import ingest

SCHEMA = (
    "doc string, at timestamp, parse_trees array<struct<head:string,h_idx:bigint,child:string,t_idx:bigint,r:string>>, "
    "mentions array<struct<mention_id:bigint,name:string,type:string,token_index:array<bigint>>>, "
    "vertexSet array<array<struct<mention_id:bigint,wikipedia_id:bigint,wikidata_id:string>>>, "
    "ent_relation array<struct<h_idx:bigint,t_idx:bigint,r:string,score:double>>"
)


def _sample(doc):
    arc = {"head": "a", "h_idx": 0, "child": "b", "t_idx": 1, "r": "x"}
    return {"doc": doc, "at": "2024-01-01T00:00:00", "parse_trees": [arc], "mentions": [], "vertexSet": [], "ent_relation": []}


def test_files_become_graphs_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: ingest.write_graphs(ingest.keep_new(ingest.stream_sections(spark, f"{tmp_path}/in", SCHEMA, 1), "doc", "at"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    for name, docs in (("1", ["p", "q"]), ("2", ["q", "r"])):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps(_sample(d)) for d in docs))
        run()
    run()  # nothing is new
    nodes, edges = (spark.read.parquet(f"{tmp_path}/out/{t}") for t in ("nodes", "edges"))
    assert sorted((r["doc"], r["n"]) for r in nodes.groupBy("doc").agg(F.count("*").alias("n")).collect()) == [("p", 2), ("q", 2), ("r", 2)]
    assert edges.count() == 3 and {r["etype"] for r in edges.collect()} == {"token-token"}
