import json

from pyspark.sql import functions as F

from netprism.operators import tree as T
from netprism.operators import tree_rows as R
from netprism.queries import QUERIES
from netprism.sources import structured as S

ODD = [
    "5", '"x"', "[]", "{}", "null", "true", '[1,[2,[3,{}]],{"a":[]}]', "{oops",
    '{"a.b":{"c/d":[1,2.50,1e3,100.0,-7,123456789012345678901234567890,null,true,"\\u001f\\n\\"q"]},"é":"ü","":1,"12":{"x y":5}}',
    json.dumps({"properties": {"config": {"hostname": "R1", "score": 1.5, "l": [1, 2.5], "o": {"q": 1}},
                               "meta": [{"key": "serialNumber", "value": "S"}, {"name": 2.5, "value": {"a": 1}}, {"key": "", "name": "n", "val": [1, "\x1f"]}]},
                "key": "k", "value": "", "text": "t", "big": ["y" * 9000, "z" * 9000]}),
    json.dumps({"n": {"a" * 300: 1}, "ints": [1, 200, 40000, 3000000000, -1, -129], "long": "w" * 500, "many": {f"k{i}": i for i in range(600)}, "arr": list(range(700)),
                "data": {"data": {"data": {"data": 1}}}}),
]
XML = '<a k="1"><b>2020-01-01</b><b>2020-01-01T10:00:00</b><c>1.50</c><d>true</d><e>1e5</e><f/></a>'


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def both(docs):
    nodes = T.walk(docs)
    same(T.leaves(nodes), R.document_leaves(docs))
    same(T.records(nodes), R.document_records(docs))
    same(nodes.select("file_id", "path", "depth", "type"), R.document_nodes(docs))
    same(T.payload_tables(nodes), T.payload_tables(R.document_nodes(docs)))


def test_one_pass_gives_what_the_walk_gives(spark):
    both(T.documents(spark.createDataFrame([(f"f{i}", j) for i, j in enumerate(ODD)], "id string, j string").repartition(3), "id", "j"))
    both(S.xml_documents(spark.createDataFrame([("x", XML), ("bad", "<a")], "f string, x string"), "f", "x"))


def test_batches_are_cut_and_keep_every_row(spark):
    docs = T.documents(spark.createDataFrame([(7, json.dumps({"rows": [{"a": i} for i in range(9000)]}))], "id long, j string"), "id", "j")
    n = R.document_nodes(docs).agg(F.count("*"), F.countDistinct("path"), F.max("depth")).first()
    assert tuple(n) == (18002, 18002, 3)
    t = T.payload_tables(R.document_nodes(docs)).collect()
    assert [(r["file_id"], r["path"], r["column"], r["presence"], r["rows"]) for r in t] == [(7, "$.rows", "a", 9000, 9000)]


def test_documents_of_a_small_table_are_many_tasks(spark):
    for name in ("tree_leaves", "tree_devices", "source_xml_leaves"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
