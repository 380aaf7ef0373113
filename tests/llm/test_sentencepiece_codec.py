import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import queries
from lexweave.llm import sentencepiece_codec as S
from tests.llm.conftest import EDGE

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def table():
    return S.ChunkTable(S._load(queries.default_model_path()), max_chunks=50)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\t aé🤗1"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_equals_the_library(text):
    t = test_equals_the_library.table = getattr(test_equals_the_library, "table", None) or S.ChunkTable(S._load(queries.default_model_path()), max_chunks=50)
    ids, decimal = t.encode(text)
    assert ids == t.whole.encode(text)
    assert decimal == ",".join(map(str, ids))
    assert t.decode(ids) == t.whole.decode(ids)


def test_table_starts_afresh(table):
    texts = [" ".join(f"w{i * 40 + j}" for j in range(40)) for i in range(6)] + ["x" * 3000 + " y", " ".join(map(str, range(500)))]
    assert [table.encode(t)[0] for t in texts] == [table.whole.encode(t) for t in texts]
    assert len(table.table) <= 50


def test_rows(spark, docs):
    got = S.encode_texts(docs(EDGE), queries.default_model_path(), digests=True).collect()
    whole = S.ChunkTable(S._load(queries.default_model_path())).whole
    texts = sorted((t or "") for _, t in EDGE)
    assert sorted(r.decoded for r in got) == sorted(whole.decode(whole.encode(t)) if t else "" for t in texts)
    assert sum(r.n_tokens for r in got) == sum(len(whole.encode(t)) for t in texts)
    assert all(len(r.token_ids) == r.n_tokens for r in got)
    assert S.encode_texts(docs([]), queries.default_model_path()).count() == 0


def test_crossing_pieces_are_refused():
    assert S.crossing_pieces(["▁a", "▁▁", "a▁b"]) == ["a▁b"]
