"""Words with characters that no piece has are solved in step with the others."""

import random

import pyarrow as pa

from quoin.llm import op10_sentencepiece as op10


def test_op10_all_short_words_are_solved_in_step():
    library, *_ = op10.loaded(op10.default_model())
    agenda = op10.Agenda.of(library)
    rng = random.Random(7)
    letters = ["a", "e", "th", "ing", "er", "é", "è", "ò", "%", "%%%", ".", "\n", "\0", "漢", "🙂", "\U0010ffff", "aaaa"]
    words = sorted({w for _ in range(4000) if len(w := "".join(rng.choices(letters, k=rng.randint(1, 12)))) < op10.SHORT})
    assert any(c not in agenda.pieces for w in words for c in w)
    in_step = dict(agenda.merged_in_step(words))
    assert set(in_step) == set(words)
    assert [[*in_step[w], agenda.end] for w in words] == library.encode(words, add_eos=True)
    agenda = op10.Agenda(agenda.pieces, None, agenda.unknown, agenda.end)
    in_step = dict(agenda.merged_in_step(words))
    assert all(in_step[w] == agenda.merge(op10.SPACE + w) for w in words)


def test_op10_ids_are_packed_as_the_library_packs_them():
    library, *_ = op10.loaded(op10.default_model())
    rng = random.Random(11)
    letters = ["a", "e", "th", "ing", "é", "%%%", ".", ".\n", "\0", "漢", "🙂", "\U0010ffff", "▁", "'", "0"]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(3000)] + ["x" * 150, "漢字" * 80, ""]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(30)] + ["", " ", "a  b", " a", "a ", "▁"]
    for cache in (op10.CACHE, 200, 2):
        agenda = op10.Agenda.of(library, cache)
        for _ in range(2):
            packed = agenda.packed_all(texts)
            assert packed == [library.encode(t, add_eos=True, return_type="numpy").tobytes() for t in texts]
        assert agenda.encode_all(texts) == list(map(op10.unpack, packed)) == library.encode(texts, add_eos=True)
        kept = agenda.kept | agenda.older
        assert kept and all(ids == op10.pack(library.encode(w) if w else agenda.merge(op10.SPACE)) for w, ids in kept.items())
    whole = op10.Agenda(agenda.pieces, None, agenda.unknown, agenda.end)
    assert whole.packed_all(["a \U0010ffff"]) == [op10.pack([*whole.merge("▁a"), *whole.merge("▁\U0010ffff"), whole.end])]


def test_op10_ids_as_a_column_of_lists():
    rows = [[1, 2, 3], [], [32000], [], list(range(5000))]
    assert op10.listed(list(map(op10.pack, rows))).equals(pa.array(rows, pa.list_(pa.int32())))
    assert op10.listed([]).equals(pa.array([], pa.list_(pa.int32())))
