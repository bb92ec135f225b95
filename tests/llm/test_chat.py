"""Formatted conversations against a plain renderer, and masks against the tokens' own characters."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import chat
from tessera.llm.chat import ChatTemplate, chat_digests, format_chats, read_chats, template_for, token_mask, write_chats
from tessera.llm.queries import tokenizer_path

TOKENIZER = tokenizer_path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"


def digests(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or "", r))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda x: x[:3])
        loss = "".join(x for _, _, x, r in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x, _ in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    path = write_chats(df.repartition(3), TOKENIZER)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_digests(read_chats(spark, path), TOKENIZER).collect()}
    assert got == digests(rows)
    return read_chats(spark, path)


ODD = ["", None, "</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s>", "\\", "<", "[", "[INST", "<|endoftext|>", "<\\|endoftext|>", "[[INST]", "<</s>", "$0 \\1", "é𝄞́ 👩‍👩‍👧", " leading", "trailing ", "\n\n", "\x00", "INST]", "/s>"]


def test_odd_texts(spark):
    rows = [(i, t, r, x) for i, x in enumerate(ODD) for t, r in ((0, "user"), (1, "assistant"), (2, None), (3, "assistant"))]
    rows += [(100 + i, 0, x, x) for i, x in enumerate(ODD)] + [(None, None, "assistant", "a"), (None, None, "assistant", "a"), (None, 0, "assistant", None)]
    random.seed(4)
    parts = ["<", "[", "\\", "/s>", "INST]", "/INST]", "|endoftext|>", "a", " "]
    rows += [(1000 + i, t, random.choice(["user", "assistant", "x</s>"]), "".join(random.choices(parts, k=random.randint(0, 12)))) for i in range(200) for t in range(3)]
    out = check(spark, rows)
    assert out.where("size(ids) <> size(mask)").count() == 0


def test_marks_are_whole_tokens_and_texts_have_none(spark):
    rows = [(1, 0, "user", "<|endoftext|></s>"), (1, 1, "assistant", "[INST] yes")]
    r = format_chats(spark.createDataFrame(rows, SCHEMA), TOKENIZER).first()
    ids = chat.mark_ids(TOKENIZER, template_for(TOKENIZER))
    assert [r.ids.count(i) for i in ids.values()] == [2, 2, 2] and 50256 not in r.ids
    assert r.formatted == "[INST]user[/INST]<\\|endoftext|><\\/s></s>[INST]assistant[/INST][\\INST] yes</s>"


def test_long_conversations_go_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_CHARS", 500)
    monkeypatch.setattr(chat, "ENCODE_CHARS", 900)
    rows = [(7, t, "assistant" if t % 2 else "user", f"turn {t} " * (t % 9)) for t in range(300)] + [(8, 0, "assistant", "w " * 600_000), (9, 0, "user", "hi")]
    out = check(spark, rows)
    assert out.where("conv_id = 7").count() > 20 and out.where("last").count() == 3


def test_ids_of_pieces_are_those_of_the_whole(spark, monkeypatch):
    rows = [(7, t, "assistant" if t % 2 else "user", f" turn  {t}\n" * (t % 9)) for t in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = format_chats(df, TOKENIZER).collect()
    monkeypatch.setattr(chat, "PIECE_CHARS", 300)
    pieces = sorted(format_chats(df, TOKENIZER).collect(), key=lambda r: r.piece)
    assert len(whole) == 1 and len(pieces) > 3
    assert [i for p in pieces for i in p.ids] == whole[0].ids and [i for p in pieces for i in p.mask] == whole[0].mask


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat_digests(format_chats(df, TOKENIZER), TOKENIZER).count() == 0
    odd = spark.createDataFrame([(1, 0, "assistant", "hi", 3, "x")], "`my conv` long, turn long, role string, `the text` string, piece int, ids string")
    r = chat_digests(format_chats(odd, TOKENIZER, conv="my conv", text="the text"), TOKENIZER, conv="my conv").first()
    assert r["my conv"] == 1 and r.loss_chars == 2


def test_templates_that_would_be_ambiguous():
    for marks in ({"begin": "<<a>"}, {"begin": "<a", "end": "b<"}, {"begin": ""}, {"begin": "a\\b"}):
        with pytest.raises(ValueError):
            ChatTemplate(**marks)
    t = ChatTemplate(begin="<u>", head=":", end="$end")
    assert list(t.turns("<u>r:x$ end$end<u>r:a<\\u>b$end")) == [("r", "x$ end"), ("r", "a<u>b")]


def test_mask_by_bisection():
    random.seed(6)
    for _ in range(200):
        cuts = np.unique([0, *random.choices(range(60), k=20)])
        starts, ends = cuts[:-1], cuts[1:]
        edges = sorted(random.sample(range(60), 6))
        spans = np.array([edges[:2], edges[2:4], edges[4:]])
        assert token_mask(starts, ends, spans).tolist() == [any(a <= s and e <= b for a, b in spans) for s, e in zip(starts, ends, strict=True)]
