"""Personal data, secrets, token counts and chat windows against plain versions."""

import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import chat, pii, secrets, tokens

PII_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(digits(s)) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits(s)[::-1])) % 10 == 0,
        "phone": lambda s: 9 <= len(digits(s)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok[k](m.group())] for k, p in PII_BASE.items()}


CASES = [
    "a@b.c@d.e f@g h@i-j.k. x..y@z.w", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 01.002.255.255 1..2.3.4.5", "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000",
    "+1 (415) 555-2671 +12 +1 ( +49.30.1234567- +1234567890123456", "+1+415 555 0000 @ @@ 5@5.5.5.5", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "é@ö.de ıñ+372 5555 5555",
]


@pytest.mark.parametrize("text", CASES)
def test_pii_cases(text):
    found = pii.find(text)
    assert {k: found[k] for k in pii.BASE} == plain_pii(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1234.@+- ()é%05", max_size=60))
def test_pii_equals_patterns(text):
    found = pii.find(text)
    assert {k: found[k] for k in pii.BASE} == plain_pii(text)


def test_pii_added():
    text = "IBAN: GB82 WEST 1234 5698 7654 32 Account no. 12345678 see https://me:pw@host.org/x and iban DE00123"
    found = pii.find(text)
    assert [text[a:b] for k in pii.ADDED for a, b in found[k]] == ["GB82 WEST 1234 5698 7654 32", "12345678", "https://me:pw@host.org"]


def test_pii_cues_in_any_case():
    text = "\u0130 aCcOuNt: 87654321, iBaN GB82WEST12345698765432 at HttpS://me:pw@host.org \u0130 a@b.org"
    found = pii.find(text)
    assert [text[a:b] for k in ("email", *pii.ADDED) for a, b in found[k]] == ["pw@host.org", "a@b.org", "GB82WEST12345698765432", "87654321", "HttpS://me:pw@host.org"]


def test_pii_rows(spark, docs, odd):
    for frame in (docs, odd):
        rows = pii.find_personal_data(frame).collect()
        texts = {r.doc_id: r.text or "" for r in frame.collect() if r.doc_id is not None}
        assert len(rows) == frame.count()
        for r in rows:
            if r.doc_id is None:
                continue
            want = plain_pii(texts[r.doc_id])
            base = ",".join(f"{k}:{a}:{b}" for k in PII_BASE for a, b in want[k])
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in PII_BASE]
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
    assert pii.find_personal_data(odd.limit(0)).count() == 0


SECRET_BASE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def plain_secrets(text):
    ok = {"assign": lambda m: len(m.group(2)) >= 6, "access": lambda m: len(m.group()) >= 20, "hex": lambda m: len(m.group()) >= 24}
    return {k: [m.span() for m in re.finditer(p, text, re.ASCII) if ok[k](m)] for k, p in SECRET_BASE.items()}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["token", "API_KEY", "apikey", "secret", ":", "=", " ", "'", '"', "abc", "x1", "AKIA", "ABCDEFGH12345678", "0af9" * 6, "0af9", "ſecret", "Kelvin"]), max_size=14).map("".join))
def test_secrets_equal_patterns(text):
    found = secrets.find(text)
    assert {k: found[k] for k in secrets.BASE} == plain_secrets(text)


def test_entropy_by_increments():
    from collections import Counter
    from math import log2

    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice("abcdefghABCDEF0123456789+/"[: rng.randint(2, 26)]) for _ in range(rng.randint(1, 90)))
        hot = set()
        for i in range(len(text) - 23):
            counts = Counter(text[i : i + 24]).values()
            if -sum(c / 24 * log2(c / 24) for c in counts) >= 3.9 - 1e-9:
                hot.update(range(i, i + 24))
        assert {k for a, b in secrets.hot_stretches(text, 24, 3.9) for k in range(a, b)} == hot


def test_entropy_and_allow_list():
    key = "q7Zp1LxV9wTr4KdN2sBy8HfM3c"
    found = secrets.find(f"x {key} 123e4567-e89b-12d3-a456-426614174000 internationalization_of_words EXAMPLE{key}")
    assert found["entropy"] == [(2, 2 + len(key))]


def test_fillers_and_one_case():
    rng = random.Random(5)
    for _ in range(200):  # no key begins like the filler before it
        key = "K" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(31))
        for text, at in ((f"xxxxxx{key}", 6), (f"{key}placeholder", 0), (f"key_example_{key}", 12)):
            alone = [(at + a, at + b) for a, b in secrets.find(key)["entropy"]]
            assert secrets.find(text)["entropy"] == alone or all(any(c <= a and b <= d for c, d in secrets.find(text)["entropy"]) for a, b in alone)
    caught = sum(bool(secrets.find("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)))["entropy"]) for _ in range(200))
    assert caught >= 180
    assert not secrets.find("internationalization/of/implementation/details xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx")["entropy"]
    assert secrets.find("sess-deadbeef01234567deadbeef")["hex"] == [(5, 29)]


def test_long_logins():
    user, word = "u" * 200, "p" * 500
    assert pii.find(f"see https://{user}:{word}@example.org/x")["login"] == [(4, 4 + 8 + 200 + 1 + 500 + 1 + 11)]


def test_secrets_of_an_empty_table(spark, odd):
    assert secrets.find_secrets(odd.limit(0)).count() == 0


def test_entropy_behind_names():
    rng = random.Random(11)
    for name in ("SESSION_KEY=", "session-key/", "example_key=", "path/to/example/", "a_b_"):
        for alphabet, n in (("0123456789ABCDEF", 40), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 40)):
            for _ in range(100):
                key = "".join(rng.choice(alphabet) for _ in range(n))
                alone, glued = secrets.find(key)["entropy"], secrets.find(f"x {name}{key}")["entropy"]
                at = 2 + len(name)
                assert all(any(c <= at + a and at + b <= d for c, d in glued) for a, b in alone) and alone
    value = "q7Zp1LxV+wTr4KdN/sBy8HfM3cJ0uGe5"
    assert secrets.find(f"example_key={value}")["entropy"] and not secrets.find("EXAMPLE" + "0A1B2C3D4E5F60718293A4B5C6D7E8F9")["entropy"]
    spans = secrets.find(f"a={value}==/{value}")["entropy"]
    assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_secret_rows(spark, docs, odd):
    for frame in (docs, odd):
        rows = secrets.find_secrets(frame).collect()
        texts = {r.doc_id: r.text or "" for r in frame.collect() if r.doc_id is not None}
        assert len(rows) == frame.count()
        for r in rows:
            if r.doc_id is not None:
                want = plain_secrets(texts[r.doc_id])
                order = sorted((a, i, b) for i, k in enumerate(SECRET_BASE) for a, b in want[k])
                base = ",".join(f"{list(SECRET_BASE)[i]}:{a}:{b}" for a, i, b in order)
                assert [r.n_assign, r.n_access, r.n_hex] == [len(want[k]) for k in SECRET_BASE]
                assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path(name)))


def test_token_counts(spark, docs, odd):
    own = library("byte_bpe_50k.json")
    for frame in (docs, odd):
        texts = sorted(((r.doc_id or -1), r.text or "") for r in frame.collect())
        rows = sorted(((r.doc_id or -1), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(frame, chunk=500, overlap=16).collect())
        want = [len(own.encode(t, add_special_tokens=False).ids) for _, t in texts]
        assert sorted(r[2] for r in rows) == sorted(want) and all(r[3] == (r[2] > 1024) for r in rows)
        assert sorted(r[1] for r in rows) == sorted(len(t.encode()) for _, t in texts)
    assert tokens.count_tokens(odd.limit(0)).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(20, 2), (64, 8), (300, 50)])
def test_splices_of_awkward_texts(chunk, overlap):
    own, rng = library("byte_bpe_50k.json"), random.Random(3)
    count = tokens.counter("byte_bpe_50k.json", chunk, overlap)
    parts = ["word", " a", "  ", "\n", "   \n ", "it's", "'ll", "'", "'s", "123456789012345678901234567890", "é", "日本語のテキスト", "𝒳", "!!!", "x" * 70, " " * 70, "<|endoftext|>", " ", "　"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 120))) for _ in range(150)] + ["a" * 2000, " " * 500 + "x", "!" * 777, "", "<|endoftext|>" * 3]
    for text in texts:
        assert count(text) == len(own.encode(text, add_special_tokens=False).ids), text


def test_libraries_agree_on_every_character():
    own, (encoding, *_) = library("byte_bpe_50k.json"), tokens._ranked("byte_bpe_50k.json")
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c} 1{c}1 {c}{c}. \n{c}\n" for c in chars]
    for at in range(0, len(texts), 20_000):
        for text, found in zip(texts[at : at + 20_000], own.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False), strict=True):
            assert found.ids == encoding.encode_ordinary(text)


def test_other_vocabularies():
    import public_tokenizers
    import sentencepiece

    text = "Ein Text mit Wörtern, and more of it."
    assert tokens.counter("word_bpe_49k.json")(text) == len(library("word_bpe_49k.json").encode(text, add_special_tokens=False).ids)
    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    assert tokens.counter("piece_bpe_32k.model")(text) == len(model.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\imend_start>a", max_size=30))
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def plain_digest(turns):
    told = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    target = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(told.encode()).hexdigest(), len(target), hashlib.sha256(target.encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "to\nol%", ""]), st.text(alphabet="ab <|im_end>\n\\", max_size=40)), min_size=1, max_size=12), st.integers(1, 60), st.integers(0, 30))
def test_windows_read_back(turns, budget, history):
    found = list(chat.windows(turns, len, budget, history))
    told, target = [], ""
    for _, text, loss, new_from, size, n_new, over in found:
        parsed = list(chat.parse(text[new_from:]))
        assert len(parsed) == n_new and size == len(text) and over == (size > budget)
        if over:  # only a turn that fits nowhere makes a window too large, and then it comes without history
            assert n_new <= 1 + (turns[0][0] == "system")
        if turns[0][0] == "system":
            assert next(chat.parse(text)) == turns[0]
        told += parsed
        target += "".join(chat.unescape(text[a:b]) for a, b in loss)
    assert told == turns and target == "".join(t for r, t in turns if r == "assistant")


def test_windows_stream_their_turns():
    read = 0

    def turns():
        nonlocal read
        for i in range(5_000):
            read += 1
            yield "system" if i == 0 else "user", f"turn {i}"

    made = 0
    for number, *_, n_new, _over in chat.windows(turns(), len, 400, 100):
        made += n_new
        assert read <= made + 1
    assert made == read == 5_000


def test_chat_rows(spark, sf):
    base = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = [(None, 0, "user", "hi"), (None, None, None, None), (-5, 1, "assistant", None), (-5, 1, "assistant", None), (-5, 0, "system", "s" * 20_000), (-6, 0, "system", "alone")]
    rows = base.unionByName(spark.createDataFrame(odd, base.schema))
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.conv_id, []).append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    for budget in (60, 1024):
        out = {r.conv_id: r for r in chat.read_back(chat.format_windows(rows, budget, budget // 4)).collect()}
        assert set(out) == set(groups)
        for conv, turns in groups.items():
            r = out[conv]
            assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == plain_digest([t[2:] for t in sorted(turns)])
    assert chat.read_back(chat.format_windows(rows.limit(0))).count() == 0


def test_chat_drops_clashing_columns(spark):
    rows = [(1, 0, "user", "hi", "x", 7, "y"), (1, 1, "assistant", "yes", None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, loss string, size int, new_from string")
    formatted = chat.format_windows(df)
    plain = chat.format_windows(df.select("conv_id", "turn", "role", "text"))
    assert formatted.schema == plain.schema and formatted.collect() == plain.collect()


def test_placeholders_among_many_stretches():
    """A word explains the stretches whose runs of letters and digits hold it, however many there are."""
    draw = random.Random(6)
    key = lambda: "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30))
    slow = lambda text: [(a, b) for a, b in secrets.random_stretches(text.replace("example", "q7Rt2Wz"))]
    text = "/".join(key() + ("example" if k % 3 == 0 else "") for k in range(300))
    every, found = slow(text), secrets.random_stretches(text)
    assert found != every and all("example" not in text[a:b] for a, b in found)
    began = time.perf_counter()
    secrets.random_stretches("/".join(key() for _ in range(20_000)) + "/example")
    assert time.perf_counter() - began < 20
