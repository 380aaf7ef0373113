from pyspark.sql import functions as F

from tests.llm.conftest import EDGE

from lexweave.llm import language_id, queries


def test_held_out_accuracy(spark):
    rows = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark, docs, tiny):
    model = language_id.fit(spark.read.parquet(f"{tiny}/documents.parquet"))
    df = docs(EDGE)
    got = language_id.predict(df, model).collect()
    assert len(got) == len(EDGE)
    by = {r.text: r for r in got}
    for text in (None, "", "   \n\t ", "… — ¡ 123 !"):
        assert (by[text].lang_pred, by[text].score, by[text].rejected) == ("und", 0.0, True)
    assert by["one"].lang_pred in model.dictionaries
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 6}) == 1
    assert language_id.predict(df.limit(0), model).count() == 0
    assert language_id.predict(df, language_id.fit(df.where("false"))).where("lang_pred <> 'und'").count() == 0


def test_one_language(spark, docs):
    model = language_id.fit(docs([(1, "only one language in here"), (2, None)]))
    row = language_id.predict(docs([(1, "some text")]), model).first()
    assert (row.lang_pred, row.score, row.rejected) == ("en", 1.0, False)


def test_split_is_by_crc32(spark):
    import zlib

    got = spark.range(200).withColumn("h", language_id.held_out(F.col("id"))).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_sizes_are_of_all_dictionaries_at_every_length(spark, tiny):
    """Every prediction against compression of each block with each dictionary, one by one."""
    import zstandard

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = language_id.fit(docs)
    search = zstandard.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=17, search_log=1, min_match=4, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)

    def plain(text):
        data, best = language_id.normalise(text), []
        for name, contents in model.dictionaries.items():
            assert len(contents) == 3
            total = 0
            for c in contents:
                d = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                for i in range(0, len(data), model.block):
                    total += len(zstandard.ZstdCompressor(dict_data=d, compression_params=search).compress(data[i : i + model.block]))
            best.append((total, name))
        best.sort(key=lambda x: x[0])
        return best[0][1], (best[1][0] - best[0][0]) / best[1][0]

    rows = [r for r in language_id.predict(docs, model).collect() if r.text and language_id.has_letter(r.text)]
    some = sorted(rows, key=lambda r: len(r.text))
    assert len(some[-1].text) > 4 * model.block > 1024 > len(some[0].text)
    wrong = [r.doc_id for r in some[::6] if (r.lang_pred, r.score) != plain(r.text)]
    assert not wrong, wrong


def test_columns_of_any_name_pass_through(spark):
    df = spark.createDataFrame([(1, "some text here", "en", 5, 6, "old")], "doc_id long, text string, lang string, _verdict int, `a.b` int, SCORE string")
    out = language_id.predict(df, language_id.fit(df))
    assert out.columns == ["doc_id", "text", "lang", "_verdict", "a.b", "lang_pred", "score", "rejected"]
    assert tuple(out.first()) == (1, "some text here", "en", 5, 6, "en", 1.0, False)
