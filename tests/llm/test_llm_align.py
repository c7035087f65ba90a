import hashlib
from collections import Counter, defaultdict

import corpus
import pytest
from hypothesis import given, settings
from test_llm_tokens import TEXTS

from tenderflow.llm import align
from tenderflow.llm.queries import BYTE_TOKENIZER, PIECE_TOKENIZER, tokenizer_path

A, B = tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER)


class Plain:
    """Whole texts, token by token."""

    def __init__(self):
        self.a, self.b = align.ByteTokenizer(A), align.PieceTokenizer(B)
        self.loaded_a, self.loaded_b = self.a.load(), self.b.load()
        letters = [c for c in range(33, 256) if c not in (*range(127, 161), 173)]
        rest = [c for c in range(256) if c not in letters]
        self.byte = {chr(c): c for c in letters} | {chr(256 + i): c for i, c in enumerate(rest)}

    def bytes_a(self, i):
        return bytes(self.byte[c] for c in self.loaded_a.id_to_token(i))

    def bytes_b(self, i):
        piece = self.loaded_b.id_to_piece(i)
        if piece.startswith("<0x") and len(piece) == 6:
            return bytes.fromhex(piece[3:5])
        return piece.replace("▁", " ").encode()

    def groups(self, text):
        """[(A ids, B ids)] of the groups, or None."""
        if not text:
            return None
        ids_a = self.loaded_a.encode(" " + text, add_special_tokens=False).ids
        ids_b = self.loaded_b.encode(text)
        parts = [[(i, self.bytes_a(i)) for i in ids_a], [(i, self.bytes_b(i)) for i in ids_b]]
        if any(b"".join(p for _, p in own) != (" " + text).encode() for own in parts):
            return None
        out, ends = [], [0, 0]
        group = [[], []]
        left = [list(own) for own in parts]
        while left[0] or left[1]:
            side = 0 if ends[0] <= ends[1] else 1
            token, piece = left[side].pop(0)
            ends[side] += len(piece)
            group[side].append(token)
            if ends[0] == ends[1]:
                out.append(group)
                group = [[], []]
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def aligner():
    return align.Aligner(align.ByteTokenizer(A), align.PieceTokenizer(B))


def text_of(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups or ())


@settings(max_examples=600, deadline=None)
@given(text=TEXTS)
def test_units_give_what_the_whole_text_gives(plain, aligner, text):
    units = align.units_of(text) if text else []
    assert "".join(units) == (" " + text if text else "")
    columns = align.documents([None, text, text], aligner, True)
    want = plain.groups(text)
    for i, groups in enumerate([None, want, want]):
        n_a, n_b, n_groups, n_links, _, told, _, times = [column[i] for column in columns]
        assert told == text_of(groups)
        assert n_a == sum(len(a) for a, _ in groups or ())
        assert n_b == sum(len(b) for _, b in groups or ())
        assert n_groups == n_links == len(groups or ()) == sum(times)


def test_slices_by_common_ends():
    assert align.slices([2, 5, 6, 9], [1, 5, 7, 9]) == [(2, 2), (4, 4)]


def test_links_are_bounded_by_the_vocabularies(aligner):
    bound = align.most_links(aligner.bytes_a, aligner.bytes_b)
    assert bound < 1_000_000 and bound <= align.MOST_SENT
    small = align.most_links([b"ab", b"b", b"c"], [b"b", b"ab", b"xc", b""])
    assert small == 5  # ab-b, ab-ab, b-b, b-ab, c-xc


def expected(plain, rows):
    found = [(r[0], plain.groups(r[1])) for r in rows]
    links = Counter((a[-1], b[-1]) for _, groups in found for a, b in groups or ())
    best = defaultdict(int)
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    out = Counter()
    for doc_id, groups in found:
        mine = [(a[-1], b[-1]) for a, b in groups or ()]
        told = hashlib.sha256(text_of(groups).encode()).hexdigest() if groups else ""
        out[doc_id, sum(len(a) for a, _ in groups or ()), sum(len(b) for _, b in groups or ()),
            len(mine), len(mine), told, sum(links[m] == best[m[1]] for m in mine),
            sum(links[m] for m in mine)] += 1
    return out


@pytest.mark.parametrize("most", [align.MOST_SENT, 0])
def test_awkward_documents(spark, plain, most):
    more = [(900, "a▁b", None, None, 0), (901, "日本" * 3000, None, None, 0),
            (902, "x\ny  z\t.\r\nq " * 500, None, None, 0), (903, "<s> <0x41> <|endoftext|>", "", "", 0)]
    rows = [r[:5] for r in corpus.awkward_rows()] + more
    docs = corpus.with_clashes(spark.createDataFrame(rows, corpus.DOCUMENTS)).repartition(3)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    frame = align.align_documents(docs, A, B, most=most)
    assert Counter(tuple(r) for r in frame.select(names).collect()) == expected(plain, rows)


def test_groups_are_given_if_asked_for(spark, plain):
    docs = spark.createDataFrame([(1, "The tree's house", "en", "a", 1)], corpus.DOCUMENTS)
    row = align.align_documents(docs, A, B, groups=True).first()
    assert row.groups == text_of(plain.groups("The tree's house"))


@pytest.mark.parametrize("most", [align.MOST_SENT, 0])
def test_no_rows(spark, most):
    assert align.align_documents(corpus.empty(spark), A, B, most=most).count() == 0


def test_kept_results_have_a_bound_in_bytes():
    own = align.Aligner(align.ByteTokenizer(A), align.PieceTokenizer(B), most=20_000)
    for i in range(60):
        long = f" {i}" + "x" * 2000
        first, _, third = own.learn([" always", f" word{i}", long])
        assert first[:2] == (1, 1) and third[0] > 0 and long not in own.now
        assert own.size <= 20_000 + 3000 and len(own.now) + len(own.before) < 150
