from graph_fixtures import DOC, doc

from weftgraph import Store
from weftgraph.operators import mutate
from weftgraph.streaming import log


def test_a_stream_of_documents_is_committed_and_tailed(spark, tmp_path):
    with Store.create(spark, str(tmp_path / "s")) as store:
        doc(spark, (1, "http://a", 1), (2, "http://b", 2)).write.parquet(str(tmp_path / "in"))
        query = log.commit_stream(spark.readStream.schema(DOC).parquet(str(tmp_path / "in")), store, lambda batch: [mutate.upsert_nodes(batch)], str(tmp_path / "state"))
        query.awaitTermination(120)
        assert len(store) == 2 and store.pending_ops == 2
        tailed = log.tail(spark, store.root, store.generation).writeStream.format("memory").queryName("ops_tail").trigger(availableNow=True).start()
        tailed.awaitTermination(120)
        assert [r["op"] for r in spark.sql("select op from ops_tail").collect()] == ["upsert"] * 2
