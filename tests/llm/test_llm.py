"""Each operator against plain Python over whole tables, and on rows made to be awkward."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tessera.llm import decontaminate, language_id, near_dedup, packing, quality_classifier, quality_rules, secret_scan, token_ids, token_store, url_rules, warc
from tessera.llm.queries import ORACLE_SQL, QUERIES
from tessera.llm.storage import fresh_path, materialize

SMALL = "/root/testdata/sf0.001"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def awkward(spark):
    """Nulls in every column, empty and blank and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = prose(80)
    rows = [
        (1, shared, "en", "a"), (2, shared, "en", None), (2, shared, "en", None), (None, shared, None, "a"), (3, None, None, None), (None, None, None, None),
        (4, "", "de", "b"), (5, " \t\n ", "de", "b"), (6, "one", "en", "b"), (7, "one two three four", "en", "b"), (8, prose(60_000), "fr", "b"),
        (9, shared + " tail", "en", "a"), (10, "123 456 !!", None, "c"), (11, "\u0130 \u00a0x\u2003y \U0001f600 e\u0301", "es", "c"), (12, shared.upper(), "en", "a"),
    ] + [(100 + k, prose(rng.randint(40, 120)), "en", f"s{k % 2}") for k in range(20)]
    return spark.createDataFrame([(*r, 0, r[0], "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, label long, token string, kept int")


def empty(df):
    return df.where("false")


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def collected(df):
    return [r.asDict() for r in df.collect()]


# ---- op1


def plain_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{kind}:{a}:{z}" for a, _, kind, z in sorted(out))


def test_secrets_match_plain_patterns(spark):
    for docs in (table(spark, "documents"), awkward(spark)):
        rows = docs.select("doc_id", "text").collect()
        expected = Counter((r[0], hashlib.sha256(plain_spans(r[1] or "").encode()).hexdigest()) for r in rows)
        assert expected == Counter((r["doc_id"], r["base_sha256"]) for r in secret_scan.scan_secrets(docs).collect())
    assert secret_scan.scan_secrets(empty(docs)).count() == 0


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | (k := (n.bit_length() + 7) // 8)]) + n.to_bytes(k, "big")) + body


def tree(data):
    """DER values that fill ``data``, nested where constructed; None if they do not fill it."""
    out, at = [], 0
    while at < len(data):
        tag, n, at = data[at], data[at + 1] if at + 1 < len(data) else None, at + 2
        if n is None:
            return None
        if n >= 128:
            k = n - 128
            if not 1 <= k <= 4 or at + k > len(data) or data[at] == 0:
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def is_private(data):
    """Whether a DER sequence begins ``data`` that holds a private key."""
    if len(data) < 18 or data[0] != 0x30:
        return False
    head = 2 if data[1] < 128 else 2 + data[1] - 128
    size = data[1] if data[1] < 128 else int.from_bytes(data[2:head], "big")
    if data[1] == 128 or data[1] > 132 or len(data) < head + size or size < 16:
        return False
    v = tree(data[head : head + size])
    if not v:
        return False
    tags = "".join(f"{t:02x}" for t, _ in v)
    small = lambda k, *allowed: v[k][0] == 2 and v[k][1] in [bytes([x]) for x in allowed]

    def numbers(w):
        return len(w) >= 6 and {t for t, _ in w} == {2} and w[0][1] in (b"\0", b"\1") and all(b for _, b in w) and max(len(b) for _, b in w) >= 16

    def curve(w, inner):
        rest = w[2:]
        return len(w) > 1 and w[0] == (2, b"\1") and w[1][0] == 4 and 20 <= len(w[1][1]) <= 66 and all(t in (0xA0, 0xA1) and tree(b) for t, b in rest) and (inner or bool(rest))

    def algorithm(b):
        w = tree(b)
        return bool(w) and w[0][0] == 6 and bool(w[0][1])

    if numbers(v) or curve(v, False):
        return True
    if tags.startswith("023004") and small(0, 0, 1) and algorithm(v[1][1]):
        w = tree(v[2][1])
        if w and len(w) == 1:
            t, b = w[0]
            if t == 0x30:
                held = tree(b)
                return bool(held) and (numbers(held) or curve(held, True))
            return t in (2, 4) and len(b) >= 16
        return False
    return tags == "3004" and algorithm(v[0][1]) and len(v[1][1]) >= 16


def plain_found(text):
    """Whether a text holds a key or signed token at all, by every place at which one could begin."""
    kinds = set()
    flat = re.sub(r"(?:\r?\n|\\r\\n|\\n)[ \t]*", "", text)
    for m in re.finditer(r"(?<![A-Za-z0-9+/_-])(?=(M[A-I][A-Za-z0-9+/_-]{38,}))", flat):
        run = m[1].replace("-", "+").replace("_", "/")
        run = run[: len(run) - 1] if len(run) % 4 == 1 else run
        if is_private(base64.b64decode(run + "=" * (-len(run) % 4))):
            kinds.add("der_key")
    for m in re.finditer(r"(?<![0-9A-Fa-f])(?=(30[0-9A-Fa-f]{62,}))", text):
        if is_private(bytes.fromhex(m[1][: len(m[1]) // 2 * 2])):
            kinds.add("der_key")
    return kinds


def secret_texts():
    """Keys in every encoding, public ones and look-alikes too."""
    rng = random.Random(11)
    number = lambda k: der(2, b"\1" + rng.randbytes(k - 1))
    rsa = der(0x30, der(2, b"\0") + b"".join(number(k) for k in (128, 3, 128, 64, 64, 64, 64, 64)))
    alg, curve = der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")), der(0x30, der(6, b"\x2a\x86\x48\xce") + der(6, b"\x2a\x86"))
    ec = der(0x30, der(2, b"\1") + der(4, rng.randbytes(32)) + der(0xA0, der(6, b"\x2a\x86")) + der(0xA1, der(3, b"\0" + rng.randbytes(64))))
    bare = der(0x30, der(2, b"\1") + der(4, rng.randbytes(32)))
    private = {
        "rsa": rsa, "ec": ec, "pkcs8_rsa": der(0x30, der(2, b"\0") + alg + der(4, rsa)), "pkcs8_ec": der(0x30, der(2, b"\0") + curve + der(4, bare)),
        "ed25519": der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, rng.randbytes(32)))), "locked": der(0x30, alg + der(4, rng.randbytes(200))), "dsa": der(0x30, der(2, b"\0") + b"".join(number(k) for k in (128, 20, 128, 128, 20))),
    }
    public = {
        "spki": der(0x30, alg + der(3, b"\0" + der(0x30, number(128) + number(3)))), "rsa_public": der(0x30, number(128) + number(3)), "noise": der(0x30, der(2, b"\0") + der(4, rng.randbytes(40))),
        "bare_ec": bare, "pkcs8_noise": der(0x30, der(2, b"\0") + alg + der(4, rng.randbytes(90))), "cut": rsa[:-9],
    }
    return private, public


def wrapped(data, width=64, end="\n"):
    text = base64.b64encode(data).decode()
    return end.join(text[k : k + width] for k in range(0, len(text), width))


def test_private_keys_are_found_in_every_form_and_public_ones_in_none():
    private, public = secret_texts()
    for name, data in private.items():
        forms = [base64.b64encode(data).decode(), data.hex(), data.hex().upper(), wrapped(data, 64), wrapped(data, 76, "\r\n"), wrapped(data, 64, "\\n"), wrapped(data, 64, "\n    ")]
        for form in forms:
            text = f"x: {form} end\nnext"
            found = secret_scan.confirmed_spans(text)
            assert [k for k, _, _ in found] == ["der_key"], (name, form[:40])
            assert (found[0][1], found[0][2]) == (3, 3 + len(form)) and plain_found(text) == {"der_key"}
        for end in ("\n", "\\n", "\\r\\n"):
            pem = f'{{"k": "-----BEGIN PRIVATE KEY-----{end}{wrapped(data, 64, end)}{end}-----END PRIVATE KEY-----{end}"}}'
            assert "pem_key" in {k for k, _, _ in secret_scan.confirmed_spans(pem)}, name
    for name, data in public.items():
        for form in (base64.b64encode(data).decode(), data.hex(), wrapped(data)):
            assert secret_scan.confirmed_spans(f"x {form} y") == [] and plain_found(f"x {form} y") == set(), name
        assert secret_scan.confirmed_spans(f"-----BEGIN PRIVATE KEY-----\n{wrapped(data)}\n-----END PRIVATE KEY-----") == [], name
    # words that follow a key on the next line are no part of it
    key = wrapped(private["rsa"])
    span = secret_scan.confirmed_spans(f"{key}\nThanks\nall")[0]
    assert span == ("der_key", 0, len(key)) and secret_scan.redact(f"{key}\nThanks", [span]) == "[SECRET]\nThanks"


def test_secret_query_matches_plain_counts_over_whole_tables(spark):
    private, public = secret_texts()
    more = [(10_000 + k, f"some {wrapped(d)} text", "x") for k, d in enumerate([*private.values(), *public.values()])]
    docs = table(spark, "documents").select("doc_id", "text", "lang").union(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    confirmed = 0
    for r in secret_scan.scan_secrets(docs).collect():
        base = [x for x in plain_spans(texts[r["doc_id"]]).split(",") if x]
        kinds = Counter(x.split(":")[0] for x in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        spans = [x for x in r["spans"].split(",") if x]
        rest = Counter(spans) - Counter(base)
        assert not Counter(base) - Counter(spans) and sum(rest.values()) == r["n_confirmed"]
        assert [int(x.split(":")[1]) for x in spans] == sorted(int(x.split(":")[1]) for x in spans)
        assert ("der_key" in {x.split(":")[0] for x in rest}) == ("der_key" in plain_found(texts[r["doc_id"]]))
        confirmed += bool(rest)
    assert confirmed >= len(private)


def test_keys_with_a_short_length_are_confirmed():
    rng = random.Random(8)
    oid = {"ed25519": b"\x2b\x65\x70", "x25519": b"\x2b\x65\x6e", "ed448": b"\x2b\x65\x71"}
    for name, size in (("ed25519", 32), ("x25519", 32), ("ed448", 57)):
        key = der(0x30, der(2, b"\0") + der(0x30, der(6, oid[name])) + der(4, der(4, rng.randbytes(size))))
        text = base64.b64encode(key).decode()
        assert text[:6] == ("MEcCAQ" if name == "ed448" else "MC4CAQ")
        found = secret_scan.confirmed_spans(f"a {text} b")
        assert found == [("der_key", 2, 2 + len(text))]
        assert secret_scan.redact(f"a {text} b", found) == "a [SECRET] b"
        assert secret_scan.confirmed_spans(f"a {text[:44]} b") == []
    for first in range(16):
        body = bytes([0x30, rng.randrange(first * 8, first * 8 + 8)]) + rng.randbytes(90)
        assert secret_scan.confirmed_spans(f"a {base64.b64encode(body).decode()}") == []


def test_structures_are_confirmed_and_look_alikes_are_not():
    rng = random.Random(1)
    number = lambda k: der(2, b"\1" + rng.randbytes(k - 1))
    key = der(0x30, der(2, b"\0") + b"".join(number(k) for k in (128, 3, 128, 64, 64, 64, 64, 64)))
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, key))
    text64 = base64.b64encode(key).decode()
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(rng.randbytes(51)) + field(rng.randbytes(136))
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256", "typ": "JWT"}).encode(), b'{"sub":1}', rng.randbytes(32)))
    cases = {
        f"a {text64} b": {"der_key"},
        f"k={base64.b64encode(pkcs8).decode()}": {"der_key"},
        f"x {key.hex().upper()} y": {"der_key"},
        f"-----BEGIN RSA PRIVATE KEY-----\n{text64}\n-----END RSA PRIVATE KEY-----": {"pem_key", "der_key"},
        f"id {base64.b64encode(ssh).decode()}": {"ssh_key"},
        f"auth {token}": {"signed_token"},
        f"a {text64[:-40]} b": set(),
        f"a MI{base64.b64encode(rng.randbytes(90)).decode()}": set(),
        "auth eyJhIjoxfQ.eyJiIjoyfQ.c2ln": set(),
        f"x 30{rng.randbytes(40).hex().upper()}": set(),
    }
    for text, kinds in cases.items():
        found = secret_scan.confirmed_spans(text)
        assert {k for k, _, _ in found} == kinds, text[:60]
        for _, lo, hi in found:
            assert 0 <= lo < hi <= len(text)
    text = f'é token = "abcdef123" and {token}.'
    clean = secret_scan.redact(text, secret_scan.base_spans(text) + secret_scan.confirmed_spans(text))
    assert clean == 'é [SECRET]" and [SECRET].'
    assert secret_scan.redact("none", []) == "none"


# ---- op2


def plain_distance(item, words):
    """Least word edits of the item to any substring, by the full table."""
    last = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        row = [i]
        for j, v in enumerate(words, 1):
            row.append(min(last[j - 1] + (w != v), last[j] + 1, row[j - 1] + 1))
        last = row
    return min(last)


def test_decontamination_matches_full_edit_tables(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice((1, 4, 7, 15, 30))))) for k in range(12)] + [(50, None), (51, "..."), (None, "w1 w2 w3 w4 w5 w6")]
    docs = []
    for k in range(80):
        body = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        passage = items[k % 12][1].split()
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(passage) + 1)
            passage[at : at + rng.randint(0, 1)] = rng.choice(([], [rng.choice(words)]))
        docs.append((k, " ".join(body[:20] + [w.upper() + "," for w in passage] + body[20:])))
    docs += [(90, None), (91, ""), (None, "w1 w2 w3 w4 w5 w6"), (92, "\u0130 " + items[3][1])]
    expected = set()
    for d, text in docs:
        for i, item in items:
            w, t = decontaminate.item_words(item), decontaminate.item_words(text)
            if w and t and (n := plain_distance(w, t)) <= int(len(w) * 0.2):
                expected.add((d, i, n))
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int")
    found = decontaminate.find_contamination(frame, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in found} == expected and len(found) == len(expected)
    assert all(r["char_start"] < r["char_end"] for r in found if r["doc_id"] not in (92,))
    gone = {d for d, _, _ in expected}
    kept = decontaminate.remove_contaminated(frame, bench)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs if d not in gone}
    assert decontaminate.find_contamination(empty(frame), bench).count() == 0 == decontaminate.find_contamination(frame, empty(bench)).count()
    assert decontaminate.remove_contaminated(frame, empty(bench)).count() == len(docs)


def test_decontamination_in_blocks(spark, monkeypatch):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    whole = Counter(decontaminate.find_contamination(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert whole == Counter(decontaminate.find_contamination(docs, items).collect()) and whole


def test_decontamination_query_matches_full_edit_tables_over_whole_tables(spark):
    docs = {r["doc_id"]: decontaminate.item_words(r["text"]) for r in table(spark, "documents").collect()}
    items = {r["item_id"]: decontaminate.item_words(r["text"]) for r in table(spark, "benchmark").collect()}
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in QUERIES["op2_benchmark_decontamination"](spark, SMALL).collect()}
    expected = {}
    for i, item in items.items():
        for d, words in docs.items():
            if sum(min(c, Counter(words)[w]) for w, c in Counter(item).items()) < len(item) * 0.5:
                continue  # too few words in common for the budget
            n = plain_distance(item, words)
            if n <= int(len(item) * 0.2):
                expected[d, i] = n
    assert found == expected


# ---- op3


def test_warc_round_trip(spark):
    big, rng = "<p>" + "payload " * 40, random.Random(2)
    blob = "".join(chr(rng.randint(32, 0x2FF)) for _ in range(3_000_000))
    rows = [(5, "http://a/x y\r\nWARC-Type: z", big), (3, None, big), (9, "u", big), (None, "n", big), (1, "s", "short"), (2, "s", "short"), (7, "e", None), (8, "e", ""), (11, "long", blob), (12, "long", blob), (3, None, big)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, refers_to int, digest string")
    manifest = warc.write_archives(pages, fresh_path(spark, "warc-test"))
    found = collected(warc.read_archives(spark, manifest, with_payload=True))
    assert Counter((r["page_id"], bytes(r["payload"]) if r["record_type"] == "response" else None) for r in found) == Counter((p, None if p in (5, 9, 12) or (p is None) else (h or "").encode()) for p, _, h in rows)
    for r in found:
        html = (next(h for p, _, h in rows if p == r["page_id"]) or "").encode()
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == hashlib.sha256(html).hexdigest()
        first = {5: 3, 9: 3, None: 3, 12: 11}.get(r["page_id"])
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if first else ("response", None))
    assert warc.archive_round_trip(empty(pages)).count() == 0


def test_revisits_are_held_against_their_response(spark):
    rows = [(1, 10, "aa", "response", None), (2, 10, "aa", "revisit", 1), (None, 3, "bb", "response", None), (3, 10, "cc", "response", None)]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    warc.verify_revisits(spark.createDataFrame(rows, schema), 4)
    warc.verify_revisits(spark.createDataFrame([], schema), 0)
    for bad in ((4, 10, "cc", "revisit", 1), (4, 11, "aa", "revisit", 1), (4, 10, "aa", "revisit", 9), (4, 10, "aa", "revisit", 2)):
        with pytest.raises(ValueError):
            warc.verify_revisits(spark.createDataFrame([*rows, bad], schema), 5)


def test_warc_reader_refuses_broken_archives():
    import io

    record = warc.build_record(1, "http://x/", b"body", hashlib.sha256(b"body").hexdigest(), None)
    both = record + warc.build_record(2, None, b"", EMPTY_SHA, None)
    for size in (1, 7, 1 << 16):
        assert [warc.parse_record(m)["page_id"] for m in warc.members(io.BytesIO(both), size)] == [1, 2]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(both[:-5])))
    plain = bytes(next(warc.members(io.BytesIO(record))))
    for bad in (plain.replace(b"body", b"bodx"), plain.replace(b"Content-Length: ", b"Content-Length: 9"), plain[:-2]):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


# ---- op4 and op10


def plain_ids(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_ids.default_vocabulary())
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_gives_the_library_s_ids(spark, monkeypatch):
    rng = random.Random(9)
    texts = [r["text"] for r in awkward(spark).collect()] + ["a  b\n\n c\t\u00a0d 'S it's 12 3.4 <|endoftext|> !!?\u3000\u4e2d\u6587", "x" * 5000, "a\x1cb \x1d c\x85 d\u2028e \x1c\x1c f\u180e g"]
    texts += ["".join(rng.choice(" \n\tab'sé1.<|\u2009\u00a0") for _ in range(200)) for _ in range(100)]
    texts += ["'", "'s", " 's", "a'", "a'sx", "a'rex 'tis x've ll 'll'd", "\n's", "''s", "'l", "x <|endoftext|>y", "<|endoftext|>", "\u1c89 a", "\U000105c0b c"]
    texts += ["".join(rng.choice(" \nab'stredvlm1.") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x3000), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randint(0, 99))) for _ in range(2000)]
    encoder = token_ids.TextEncoder(token_ids.default_vocabulary())
    expected = [ids[:-1] for ids in plain_ids(texts, 0)]
    assert [ids.tolist() for ids in encoder.encode_many(texts)] == expected
    assert [np.frombuffer(encoder.encode(text), "<u4").tolist() for text in texts[:200]] == expected[:200]
    monkeypatch.setattr(token_ids, "PASS_CHARS", 150)
    encoder = token_ids.TextEncoder(token_ids.default_vocabulary())
    encoder.table.most = 50
    assert [ids.tolist() for ids in encoder.encode_many(texts)] == expected


def test_encoder_takes_any_number_of_line_ends_without_a_space():
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    lines = [word() + rng.choice(("", ",", "7", "\u4e2d", "...")) for _ in range(5000)]
    texts = ["\n".join(word() for _ in range(5000)), "\n".join(lines), "two words " + "\n".join(lines) + " end", "\n".join([*lines, "", *lines]), "\n".join([*lines[:9], "\tx", "y\t", *lines])]
    texts += ["\n".join("\u4e2d\u6587\u5b57" for _ in range(5000)), "\r\n".join(lines), "\n".join(lines) + "\n"]
    encoder = token_ids.TextEncoder(token_ids.default_vocabulary())
    for text, ids in zip(texts, plain_ids(texts, 0), strict=True):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids[:-1]


def check_packing(docs, found):
    ids = defaultdict(list)
    for r, x in zip(docs, plain_ids([r["text"] for r in docs], 1), strict=True):
        ids[r["doc_id"]].append(x)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for d, wholes in ids.items():
        assert sum(r["length"] for r in by_doc[d]) == sum(map(len, wholes))
        if len(wholes) == 1:
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(wholes[0]) and r["ids_crc32"] == crc(wholes[0][at : at + r["length"]]) and r["length"] > 0
                at += r["length"]
    padding = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_packing(spark):
    for docs in (table(spark, "documents"), awkward(spark)):
        found = packing.pack_documents(docs).collect()
        assert check_packing(docs.collect(), found) == 0
        place = {}
        for r in found:
            place.setdefault(r["sequence_id"] >> 40, []).append(r["curve"])
        bounds = [(min(c), max(c)) for _, c in sorted(place.items())]
        assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:], strict=False))
    assert packing.pack_documents(empty(docs)).count() == 0


def test_neighbours_on_the_curve_are_alike(spark):
    docs = table(spark, "documents").where("length(text) > 400").dropDuplicates(["text"])
    words = {r["doc_id"]: frozenset(r["text"].split()) for r in docs.collect()}
    found = {}
    for r in packing.pack_documents(docs).collect():
        found[r["doc_id"]] = (r["curve"], r["doc_id"])
    order = sorted(found, key=found.get)
    alike = lambda pairs: float(np.mean([len(words[a] & words[b]) / len(words[a] | words[b]) for a, b in pairs]))
    rng = random.Random(1)
    apart = [(rng.choice(order), rng.choice(order)) for _ in range(2000)]
    assert alike(zip(order, order[1:], strict=False)) > 1.3 * alike((a, b) for a, b in apart if a != b)


def test_merkle_tree_matches_its_definition():
    sha = lambda x: hashlib.sha256(x).digest()

    def root(level):
        while len(level) > 1:
            pairs = [sha(b"\1" + level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)]
            level = pairs + level[len(pairs) * 2 :]
        return level[0]

    leaves = [bytes([k]) for k in range(70)]
    assert all(token_store.merkle_root(leaves[:n]) == root([sha(b"\0" + x) for x in leaves[:n]]) for n in range(1, 70))
    assert token_store.merkle_root([]) == sha(b"")


def test_hot_chunks_are_split(spark):
    rows = [(k, None) for k in range(3000)] + [(5000 + k, "stock text of many") for k in range(2500)] + [(9000, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = fresh_path(spark, "store-test")
    token_store.write_store(docs, path)
    found = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_store.read_store(spark, path).collect()}
    ids = plain_ids([t for _, t in rows], 2)
    assert found == {d: (len(x), crc(x)) for (d, _), x in zip(rows, ids, strict=True)}


def test_hilbert_neighbours_touch():
    n = 1 << 4
    grid = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    key = packing.hilbert_key(grid, 4)
    assert sorted(key.tolist()) == list(range(n**3))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_token_store(spark):
    for docs in (table(spark, "documents"), awkward(spark)):
        rows = sorted(docs.collect(), key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"]))
        ids = plain_ids([r["text"] for r in rows], 2)
        path = fresh_path(spark, "store-test")
        token_store.write_store(docs, path)
        found = token_store.read_store(spark, path).collect()
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == Counter((r["doc_id"], len(x), crc(x)) for r, x in zip(rows, ids, strict=True))
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
        assert order == [r["doc_id"] for r in rows]
        whole = Counter((r["doc_id"], tuple(r["ids"])) for r in token_store.read_ids(spark, path).collect())
        assert whole == Counter((r["doc_id"], tuple(x)) for r, x in zip(rows, ids, strict=True))
        chunks = spark.read.parquet(f"{path}/chunks")
        assert chunks.count() == chunks.select("hash").distinct().count()
        stored = [f for f in spark.read.parquet(f"{path}/recipes").select("_metadata.file_path", "doc_id").collect()]
        last = {}
        for f, d in sorted(stored, key=lambda x: x[0]):
            last.setdefault(f, []).append(-1 if d is None else d)
        flat = [d for f in sorted(last) for d in last[f]]
        assert all(v == sorted(v) for v in last.values()) and sorted(flat) == flat
    path = fresh_path(spark, "store-test")
    token_store.write_store(empty(docs), path)
    assert token_store.read_store(spark, path).count() == 0


def test_token_store_notices_changed_files(spark):
    from pyspark.sql import functions as F

    path = fresh_path(spark, "store-test")
    token_store.write_store(table(spark, "documents"), path)
    bad = fresh_path(spark, "store-test")
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{bad}/{name}")
    chunks = spark.read.parquet(f"{path}/chunks")
    other = token_store._stage(token_ids.default_vocabulary(), 2)
    assert other
    payload = chunks.first()["payload"]
    chunks.withColumn("payload", F.lit(bytearray(payload))).write.parquet(f"{bad}/chunks")
    with pytest.raises(Exception, match="does not match its address"):
        token_store.read_store(spark, bad).collect()


def test_chunks_meet_again_after_an_insertion():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 40_000).astype(np.uint32)
    other = np.concatenate([ids[:5000], rng.integers(0, 50_000, 7).astype(np.uint32), ids[5000:]])
    cut = lambda x: {x[a:b].tobytes() for a, b in zip([0, *token_store.chunk_bounds(x)], token_store.chunk_bounds(x), strict=False)}
    assert len(cut(ids) - cut(other)) <= 3 < len(cut(ids))
    assert token_store.chunk_bounds(ids)[-1] == len(ids) and token_store.chunk_bounds(ids[:0]) == []
    assert max(np.diff([0, *token_store.chunk_bounds(np.zeros(30_000, np.uint32))])) <= token_store.MAX_CHUNK


# ---- op5


def plain_quality(rows, max_docs=quality_rules.MAX_DOCS):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    norm = lambda x: hashlib.md5(re.sub("[0-9]+", "0", x.strip(quality_rules.SPACES).lower()).encode()).hexdigest()[:16]
    held, out = defaultdict(set), []
    for r in rows:
        lines = [x for x in (r["text"] or "").split("\n") if words(x)]
        known = frozenset(map(norm, lines))
        for x in lines:
            held[r["source"] or "", norm(x)].add(known)
    for r in rows:
        text = r["text"] or ""
        w, lines = words(text), [x for x in text.split("\n") if words(x)]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = Counter(windows)
        repeat = len({j for i, x in enumerate(windows) if count[x] > 1 for j in (i, i + 1, i + 2)})
        removed = sum(len(words(x)) for x in lines if len(held[r["source"] or "", norm(x)]) > max_docs)
        failed = len(w) < 50 or 100 * repeat > 50 * len(w)
        out.append((r["doc_id"], len(w), len("".join(w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, failed, not failed and not 100 * removed > 50 * len(w), removed))
    return Counter(out)


def test_quality_rules_match_plain_python(spark):
    for docs in (table(spark, "documents"), awkward(spark)):
        for most in (1, 20):
            assert Counter(tuple(r) for r in quality_rules.judge_quality(docs, max_docs=most).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words").collect()) == plain_quality(docs.collect(), most)
    assert quality_rules.judge_quality(empty(docs)).count() == 0


def test_quality_stage_takes_lines_out(spark):
    rng = random.Random(4)
    own = lambda k, n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    rows = [(k, f"{own(k, 60)}\n Share 12 THIS page \n{own(k, 9)}", "h") for k in range(30)] + [(40, "share 9 this page\n" * 30, "h"), (41, own(41, 60), "h"), (41, own(41, 60), "h")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, source string, n_chars long")
    out = quality_rules.apply_quality(docs)
    assert out.columns == docs.columns
    found = Counter((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect())
    expected = Counter()
    for d, text, _ in rows:
        if d != 40:
            clean = "\n".join(x for x in text.split("\n") if "page" not in x)
            expected[d, clean, len(clean)] += 1
    assert found == expected


def test_documents_that_share_most_lines_count_each(spark):
    rng = random.Random(6)
    own = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    shared = [own(5) for _ in range(30)]
    rows = [(k, "\n".join([*shared, own(8)]), host) for host, base, n in (("over", 0, 21), ("at", 100, 20)) for k in range(base, base + n)]
    rows += [(200 + k, "\n".join([own(60), "a line of copies"]), "copies") for k in (0,)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {(r["doc_id"], r["removed_words"], r["kept"]) for r in quality_rules.judge_quality(docs).collect()}
    assert found == {(k, 150, False) for k in range(21)} | {(k, 0, True) for k in range(100, 120)} | {(200, 0, True)}


def clashing(docs):
    """``docs`` with columns of names that operators use within."""
    from pyspark.sql import functions as F

    names = ["_id", "_hash", "_lines", "_gone", "removed", "row", "key", "rest", "id", "words", "lines", "host", "pos", "line", "row_hash", "_part", "_rows", "h", "n", "page", "item"]
    return docs.withColumns({c: F.lit(c) for c in names})


def test_stages_on_awkward_rows(spark):
    from pyspark.sql import functions as F

    docs = clashing(awkward(spark))
    items = spark.createDataFrame([(1, "nothing of this is there at all", "x")], "item_id long, text string, row string")
    stages = {
        "quality": lambda d: quality_rules.apply_quality(d), "dedup": lambda d: near_dedup.keep_one(d), "decontaminate": lambda d: decontaminate.remove_contaminated(d, items), "secrets": lambda d: secret_scan.redact_secrets(d),
    }
    for name, stage in stages.items():
        out = stage(docs)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert stage(docs.where("false")).count() == 0, name
        kept = Counter(r["doc_id"] for r in out.collect())
        if name == "quality":
            verdict = {r[0]: r[7] for r in plain_quality(docs.collect())}
            assert {d: n for d, n in kept.items() if d is not None} == Counter(r["doc_id"] for r in docs.collect() if r["doc_id"] is not None and verdict[r["doc_id"]]) and kept[None] == 1
        if name in ("decontaminate", "secrets"):
            assert kept == Counter(r["doc_id"] for r in docs.collect()), name
    low = quality_rules.apply_quality(docs.withColumn("n_chars", F.lit(None).cast("long")), max_docs=1, max_removed_percent=100).collect()
    assert all("page" in r.asDict() for r in low)
    assert packing.pack_documents(docs).count() > 0 and url_rules.judge_urls(clashing(table(spark, "pages"))).count() == 50


def test_lines_fire_on_the_driver_s_table(spark):
    from tessera.llm.queries import ORACLE_SQL as sql

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SMALL}/documents.parquet')")
    found = QUERIES["line_frequency"](spark, SMALL)
    columns = sorted(found.columns)
    rows = found.select(*columns).collect()
    expected = con.execute(f"select {', '.join(columns)} from ({sql['line_frequency']})").fetchall()
    assert Counter(tuple(map(as_text, r)) for r in rows) == Counter(tuple(map(as_text, r)) for r in expected) and any(r["removed_words"] for r in rows)


def test_quality_plan_has_no_python(spark):
    plan = quality_rules.judge_quality(table(spark, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- op6


def plain_components(rows):
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by_shingle = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by_shingle[x].append(i)
    common = Counter()
    for held in by_shingle.values():
        for b in range(len(held)):
            for a in range(b):
                common[held[a], held[b]] += 1
    for (a, b), n in common.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    best = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None and sets[i]:
            best[find(i)] = min(best.get(find(i), r["doc_id"]), r["doc_id"])
    out = Counter()
    for i, r in enumerate(rows):
        c = best.get(find(i), r["doc_id"]) if sets[i] else r["doc_id"]
        out[r["doc_id"], len(sets[i]), c, c == r["doc_id"]] += 1
    return out


def near_copies(spark):
    """Groups of edited copies: chains, stars with many differing members, copies of copies, and a shared passage."""
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(5000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 2)] = [rng.choice(vocabulary) for _ in range(rng.randint(0, 2))]
        return words

    texts = []
    for _ in range(3):
        base = prose(rng.randint(120, 260))
        texts += [edited(base, rng.randint(0, 12)) for _ in range(90)]
        chain = base
        for _ in range(25):
            chain = edited(chain, 1)
            texts.append(chain)
        cut = edited(base, 9)
        texts += [edited(cut, rng.randint(0, 3)) for _ in range(25)]
        texts += [base[: rng.randint(60, len(base))] for _ in range(25)]
    passage = prose(60)
    texts += [prose(25) + passage + prose(10) for _ in range(60)] + [prose(rng.randint(1, 7)) for _ in range(30)]
    rng.shuffle(texts)
    return spark.createDataFrame([(k, " ".join(w), k) for k, w in enumerate(texts)], "doc_id long, text string, token int")


def test_near_duplicates_match_all_pairs(spark):
    for docs in (table(spark, "documents"), awkward(spark), near_copies(spark)):
        found = Counter(tuple(r) for r in near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect())
        assert found == plain_components(docs.collect())
    assert near_dedup.near_duplicates(empty(docs)).count() == 0


def test_all_ways_to_a_link_are_taken(spark, monkeypatch):
    taken = Counter()
    for name in ("_delta_links", "_residual_links"):
        whole = getattr(near_dedup, name)
        monkeypatch.setattr(near_dedup, name, lambda *a, f=whole, k=name: (taken.update({k: (out := f(*a)).count()}), out)[1])
    near_dedup.near_duplicates(near_copies(spark)).count()
    assert taken["_delta_links"] > 0 and taken["_residual_links"] > 0


def test_one_of_each_group_is_kept(spark):
    docs = awkward(spark)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and not {2, 9} & set(ids) and {3, 4, 5, 6, 7, 8, 10, 11} <= set(ids)
    twice = docs.unionByName(docs.where("doc_id >= 100"))
    assert Counter(r["doc_id"] for r in near_dedup.keep_one(twice).collect() if r["doc_id"] is not None and r["doc_id"] >= 100) == Counter(range(100, 120))


# ---- op7 and op9


def test_quality_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    found = {r["doc_id"]: r for r in QUERIES["op7_quality_classifier"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in found.items())
    held = [(found[r["doc_id"]]["score"], r["quality"]) for r in labels if r["doc_id"] in found and found[r["doc_id"]]["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad) > 0.93


def test_ftrl_matches_a_plain_one():
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(40):
        at = np.sort(rng.choice(50, 8, replace=False)).astype(np.int32)
        rows.append((int(rng.random() < 0.5), at, rng.random(8).astype(np.float32)))
    z, n, order = defaultdict(float), defaultdict(float), np.random.default_rng(7)
    alpha, beta, l1, l2 = 0.3, 1.0, 1e-3, 1e-2
    bias = 1 << quality_classifier.BITS

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(3):
        for k in order.permutation(len(rows)):
            label, at, value = rows[k]
            x = {**dict(zip(at.tolist(), value.tolist(), strict=True)), bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - label) * x[i]
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    found = quality_classifier.train(rows)
    for i in [*range(50), bias]:
        assert abs(found[i] - weight(i)) < 1e-4
    assert not found[50:bias].any()


def test_classifier_s_scores_match_plain_ones(spark):
    weights = np.random.default_rng(6).normal(size=(1 << quality_classifier.BITS) + 1).astype(np.float32)
    docs = awkward(spark).select("doc_id", "text")
    plain = Counter()
    for r in docs.collect():
        grams = quality_classifier.places(r["text"])
        z = float(weights[-1]) + sum(float(weights[g]) for g in grams) / math.sqrt(max(1, len(grams)))
        plain[r["doc_id"], round(1 / (1 + math.exp(-max(-35, min(35, z)))), 5)] += 1
    assert Counter((r["doc_id"], round(r["score"], 5)) for r in quality_classifier.score(docs, weights).collect()) == plain


def test_samples_have_their_bounds(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    twice = docs.unionByName(docs).unionByName(docs)
    assert np.array_equal(quality_classifier.fit(docs, labels), quality_classifier.fit(twice, labels))
    assert not np.array_equal(quality_classifier.fit(docs, labels), quality_classifier.fit(docs, labels, sample_words=500))
    seen = []
    whole = language_id.ByteNet.train
    try:
        language_id.ByteNet.train = lambda self, x, y: seen.append(len(x))
        language_id.fit(docs, sample_windows=100)
        language_id.fit(twice, sample_rows=10)
        language_id.fit(docs)
    finally:
        language_id.ByteNet.train = whole
    assert 100 <= seen[0] < 300 and seen[1] < seen[2] <= 12_000 + 700


def test_classifier_on_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 13)] + [(None, 1, 0), (2, None, 0), (3, 1, 1)], "doc_id long, quality int, text int")
    found = quality_classifier.classify_quality(docs, labels)
    assert found.count() == docs.count() and found.where("score between 0 and 1").count() == docs.count()
    assert {r["score"] for r in quality_classifier.classify_quality(docs, empty(labels)).collect()} == {0.5}
    assert quality_classifier.classify_quality(empty(docs), labels).count() == 0
    again = quality_classifier.classify_quality(docs, labels)
    key = lambda r: (str(r["doc_id"]), r["score"])
    assert sorted(found.collect(), key=key) == sorted(again.collect(), key=key)


def test_language_id_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op9_language_id"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in found) and len(found) == len(truth)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in found if r["held_out"] and truth[r["doc_id"]]]
    assert sum(held) / len(held) > 0.97


def test_language_id_on_awkward_rows(spark):
    docs = awkward(spark)
    found = language_id.identify_languages(docs).collect()
    und = {r["doc_id"] for r in found if r["lang_pred"] == "und"}
    assert und == {3, 4, 5, 10, None} and len(found) == docs.count()
    assert {r["lang_pred"] for r in found} <= {"und", "en", "de", "fr", "es"}
    assert {r["lang_pred"] for r in language_id.identify_languages(docs.withColumn("lang", docs["lang"].substr(0, 0)).where("lang = 'zz'")).collect()} == set()
    assert language_id.identify_languages(empty(docs)).count() == 0


def test_folded_tables_give_the_network_s_values():
    net = language_id.ByteNet(["a", "b", "c"])
    x = np.random.default_rng(2).integers(0, 256, (5, language_id.WINDOW + language_id._OVER)).astype(np.uint8)
    embedded, pooled = net.p["embed"][x], []
    for w in language_id.WIDTHS:
        spans = np.concatenate([embedded[:, k : k + language_id.WINDOW] for k in range(w)], axis=2)
        pooled.append(np.maximum((spans @ net.p[f"w{w}"] + net.p[f"c{w}"]).max(axis=1), 0))
    z = np.concatenate(pooled, axis=1) @ net.p["out"] + net.p["bias"]
    assert np.allclose(net.predict(net.folded(), x), np.exp(z) / np.exp(z).sum(axis=1, keepdims=True), atol=1e-4)
    assert len(language_id.windows(b"")) == 1 and language_id.windows(b"x" * 400).shape[0] == 3


def test_network_s_gradients():
    rng = np.random.default_rng(3)
    net = language_id.ByteNet(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (4, language_id.WINDOW + language_id._OVER)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        prob = net.predict(net.folded(), x)
        return -np.log(prob[np.arange(4), y]).mean()

    for name, g in net._step(x, y).items():
        flat = np.abs(g).ravel().argsort()[-3:]
        for at in flat:
            i = np.unravel_index(at, g.shape)
            keep = net.p[name][i]
            net.p[name][i] = keep + 1e-5
            up = loss()
            net.p[name][i] = keep - 1e-5
            down = loss()
            net.p[name][i] = keep
            assert abs((up - down) / 2e-5 - g[i]) < 1e-4 + 1e-2 * abs(g[i]), name


# ---- op8


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in url_rules.SITE_RULES if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    low = None if url is None else re.sub("[A-Z]", lambda m: m[0].lower(), url)
    hit = next((r for r in url_rules.PATTERN_RULES if low is not None and re.search(r.pattern, low)), None)
    return host, path, best.name if best else None, best.verdict if best else "block" if hit else "allow", hit.pattern if hit else None


URLS = [
    None, "", "://", "http://", "no scheme", "HTTP://A.Example.NET/en/x", "http://example.net/en", "http://example.net", "http://net/", "http://xnet/", "http://my-net/", "http://a.net?x=/en/", "http://org/fr/#a",
    "http://b.org/fr/", "http://b.org:80/fr/", "http://x.example.com/de/1", "http://example.com/DE/1", "http://a/ads/1", "http://ads.b.com/", "http://ads.b.net/en/", "http://best-casino.com/x", "http://casinoroyale.com/", "http://a/f.zip?x",
    "http://a/wp-login.php", "http://a/?PHPSESSID=1", "http://a//b://c.net/", "http://\u0130.net/\u00e9?q", "http://a.org/fr/x://y", "http://xxx/", "http://a.com/login", "http://a.com/blogin/login?x", "http://example.net.org/fr/",
]


def test_url_verdicts_match_all_rules_run(spark):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)] + [(None, URLS[5], "x", "y"), (3, URLS[3], "x", "y")], "page_id long, url string, host string, token string")
    found = url_rules.judge_urls(pages)
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["pattern"]) for r in found.collect()) == Counter((r["page_id"], *plain_verdict(r["url"])) for r in pages.collect())
    assert url_rules.judge_urls(empty(pages)).count() == 0
    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    assert Counter(con.execute(ORACLE_SQL["op8_url_filters"]).fetchall()) == Counter((r["page_id"], *plain_verdict(r["url"])) for r in pages.collect())


def test_few_rules_run(spark):
    rows = url_rules.judge_urls(table(spark, "pages")).collect()
    assert max(r["rules_run"] for r in rows) <= 3


# ---- SQL and pipeline


def as_text(v):
    return "~" if v is None or v != v else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    found = QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    expected = con.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert Counter(tuple(map(as_text, r)) for r in found.select(*columns).collect()) == Counter(tuple(map(as_text, r)) for r in expected)


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = table(spark, "documents")
    columns = docs.columns
    rows = docs.collect()
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SMALL), "test")
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    verdict = {r[0]: r[7] for r in plain_quality(rows)}
    assert {r["doc_id"] for r in out["quality_rules"]} == {d for d, kept in verdict.items() if kept}
    assert {r["doc_id"] for r in out["minhash_near_dedup"]} == {d for d, _, _, kept in plain_components(out["quality_rules"]) if kept}
    items = [decontaminate.item_words(r["text"]) for r in table(spark, "benchmark").collect()]
    dirty = {r["doc_id"] for r in out["minhash_near_dedup"] if any(" ".join(i) in " ".join(decontaminate.item_words(r["text"])) for i in items)}
    kept = {r["doc_id"] for r in out["benchmark_decontamination"]}
    assert dirty and not dirty & kept and len(kept) >= len(out["minhash_near_dedup"]) - len(dirty) - 2
    before = {r["doc_id"]: r["text"] for r in out["benchmark_decontamination"]}
    for r in out["secret_scans"]:
        spans = secret_scan.base_spans(before[r["doc_id"]])
        assert (r["text"] == before[r["doc_id"]]) == (not spans) and not secret_scan.base_spans(r["text"])
    assert len(before) == len(out["secret_scans"])
    check_packing(out["secret_scans"], out["packing"])
    assert Counter(tuple(r)[:5] for r in QUERIES["pipeline"](spark, SMALL).collect()) == Counter(tuple(r)[:5] for r in out["packing"])
