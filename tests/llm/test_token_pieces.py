"""op1's encoder: what it asks of the tokenizer, and its ids against the tokenizer's own on whole texts."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from auditspark.llm import token_ids


class Counted(dict):
    """A dictionary that counts how often it is asked."""

    asked = 0

    def get(self, *args):
        self.asked += 1
        return super().get(*args)


def test_equal_pieces_of_several_texts_are_looked_up_once():
    tool = token_ids.Encoder(token_ids.TOKENIZER)
    tool.number = Counted()
    found = tool.encode(pa.array(["start of one and one and one\n"[:-1]] * 200))
    assert len({x.tobytes() for x in found}) == 1 and tool.number.asked < 20


def test_punctuation_after_a_known_word_is_not_encoded_with_it(monkeypatch):
    tool = token_ids.Encoder(token_ids.TOKENIZER)
    tool.encode(pa.array(["x alpha beta\ngamma"]))
    sent = []

    class Spy:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return real.encode_batch_fast(texts, **options)

    real, tool.tokenizer = tool.tokenizer, Spy()
    text = "x alpha### beta.%%% alpha,\ngamma!!"
    assert tool.encode(pa.array([text]))[0].tolist() == real.encode(text, add_special_tokens=False).ids
    assert sent and not any(w in t for t in sent for w in ("alpha", "beta", "gamma"))


@pytest.mark.parametrize("seed", range(4))
def test_ids_are_the_tokenizers(seed):
    rng = random.Random(seed)
    atoms = ["a", "Wort", "é", "漢字", "word's", "don't", "x9", "12", "_", "-", "###", ".,", "&&&", "(", ")", "'", "\"", "…", "¿", "<|endoftext|>", "<|", "|>", "é", "ʼ", "²", "Ⅷ", "🙂"]
    gaps = ["", "", " ", " ", " ", "\n", "\n\n", "  ", "\t", " \n", "\r\n", " ", " ", "\x0b", " \t", "\x1c"]
    tool = token_ids.Encoder(token_ids.TOKENIZER)
    for _ in range(60):
        some = gaps[: rng.choice([5, 6, len(gaps)])]
        texts = ["".join(rng.choice(atoms) + rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 12))]
        texts += rng.choice([[], [None], ["", None, ""], ["\n"], [" "]])
        rng.shuffle(texts)
        expected = [tool.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in tool.encode(pa.array(texts, pa.string()))] == expected
        assert [x.tolist() for x in tool.encode(pa.array(["é", *texts, "b"], pa.string()).slice(1, len(texts)))] == expected


def test_slices_by_bytes():
    texts = ["a" * n for n in (3, 0, 9, 30, 1, 1, 1, 50, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], names=["doc_id", "text"])
    cut = list(token_ids.by_bytes(iter([batch, batch.slice(0, 0)]), 10))
    assert [i for b in cut for i in b.column(0).to_pylist()] == list(range(10)) and len(cut) > 3
    assert all(sum(len(t or "") for t in b.column(1).to_pylist()[1:]) < 10 for b in cut)
