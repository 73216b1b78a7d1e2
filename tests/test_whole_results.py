"""Rows that the filtered result of a query leaves out are compared too."""

from pyspark.sql import functions as F

from corpusloom.plans.table_queries import context, corpus

SF_DIR = "/root/testdata/sf0.001"


def test_vectors_lost_outside_the_filter_are_seen(spark, monkeypatch):
    append = context.store.append_vectors
    monkeypatch.setattr(context.store, "append_vectors", lambda d, *a, **o: append(d.where("language <> 'l2'"), *a, **o))
    assert {r["strangers"] > 0 for r in context.vector_roundtrip(spark, SF_DIR).collect()} == {True}


def test_documents_whose_file_is_ignored_are_compared(spark, monkeypatch):
    scan = corpus.files.scan_folder
    lost = F.regexp_extract("rel_path", "/d([0-9]+)/", 1).cast("int") % 4 == 3
    monkeypatch.setattr(corpus.files, "scan_folder", lambda *a, **o: scan(*a, **o).where(~lost))
    assert {r["read"] for r in corpus.corpus_scan(spark, SF_DIR).collect()} == {False}
