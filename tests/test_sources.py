from kinweave.sources import tables


def test_long_ids(spark):
    """Ids of over six digits stay whole, and shorter ones are padded as before."""
    ids = [7, 123456, 1234567, 1234568, 12345678]
    docs = spark.createDataFrame([(i, "en", f"text {i}") for i in ids], "doc_id long, lang string, text string")
    got = sorted(r.entity_id[3:] for r in tables.from_documents(docs).collect())
    assert got == sorted(["000007", "123456", "1234567", "1234568", "12345678"])
