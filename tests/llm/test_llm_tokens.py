import corpus
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tenderflow.llm import packing, tokens
from tenderflow.llm.queries import BYTE_TOKENIZER, WORD_TOKENIZER, tokenizer_path

BYTES, WORDS = tokenizer_path(BYTE_TOKENIZER), tokenizer_path(WORD_TOKENIZER)
PARTS = ["the", " ", "  ", "\n", "\t", "\r\n", "Ève", "it's", ".", ",", "!!", "'s", "12", " ",
         "<|endoftext|>", "<|startoftext|>", "<|", "ΑΣ", "İ", "é", "́", "日本", "\x00",
         "\x1c", "a$%", "ﬁ", "Å", "̸", "=", "µ", "ß", "ª"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=25).map("".join) | st.text(max_size=40)


@pytest.fixture(scope="module")
def loaded():
    return (tokens.load_tokenizer(BYTES), tokens.counter(BYTES), tokens.load_tokenizer(WORDS),
            packing.token_bytes(WORDS))


@settings(max_examples=600, deadline=None)
@given(text=TEXTS)
def test_units_give_what_the_whole_text_gives(loaded, text):
    by_bytes, counter, by_words, ids = loaded
    units = tokens.byte_units(text)
    assert "".join(units) == text
    known = counter.learn(set(units))
    assert sum(known[u] for u in units) == len(by_bytes.encode(text, add_special_tokens=False))
    found, ends = packing.joined_ids(packing.word_units(pa.array([text, None, text])), ids)
    whole = [*by_words.encode(text, add_special_tokens=False).ids, packing.END_ID]
    assert found.tolist() == [*whole, packing.END_ID, *whole]
    assert ends.tolist() == [len(whole), len(whole) + 1, 2 * len(whole) + 1]


@pytest.mark.parametrize("text, n", [("name\u00a0: x\n\n\ny\u00a0! z", 10), ("x\ty\n\n\n\nz\tq\tr", 11)])
def test_other_white_space_does_not_make_up_for_runs(loaded, text, n):
    by_bytes, counter, *_ = loaded
    units = tokens.byte_units(text)
    known = counter.learn(set(units))
    assert len(by_bytes.encode(text, add_special_tokens=False)) == n
    assert sum(known[u] for u in units) == n


def test_kept_results_have_a_bound():
    kept = tokens.Kept(lambda batch: [len(unit) for unit in batch], sum, most=3000)
    for i in range(100):
        known = kept.learn({"always", f"word{i}", f"mark{i}."})
        assert known["always"] == 6 and known[f"mark{i}."] == len(f"mark{i}.")
        assert len(kept.now) + len(kept.before) <= 40


@pytest.mark.parametrize("make", [lambda: tokens.counter(BYTES), lambda: packing.token_bytes(WORDS)])
def test_texts_without_spaces_are_not_kept(make):
    """50 MB of them leave less than a kilobyte."""
    kept = make()
    for i in range(10):
        texts = {f"{i}-{j}-" + "xyz" * 1_700 for j in range(1000)}
        known = kept.learn(texts)
        assert all(known[text] for text in texts)
    assert kept.size < 1000 and len(kept.now) + len(kept.before) < 10


def test_a_worker_keeps_results_of_its_tasks():
    assert tokens.kept_by_worker(tokens.counter, BYTES) is tokens.kept_by_worker(tokens.counter, BYTES)


def test_counts_of_awkward_documents(spark):
    docs = corpus.with_clashes(corpus.awkward(spark))
    tokenizer = tokens.load_tokenizer(BYTES)
    found = [tuple(r) for r in tokens.token_counts(docs, BYTES).collect()]
    want = [
        (i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False)))
        for i, t, *_ in corpus.awkward_rows()
    ]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert tokens.token_counts(corpus.empty(spark), BYTES).count() == 0


def test_portions_are_bounded():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * (1 << 20)] * 9 + [None, ""]})
    parts = list(tokens.portions([batch], "text"))
    assert sum(p.num_rows for p in parts) == 11 and max(p.num_rows for p in parts) <= 4
