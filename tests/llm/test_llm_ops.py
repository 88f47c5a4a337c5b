"""The ten operators and the pipeline against brute force, on small tables with nulls, ties, repeats and odd texts."""

import base64
import hashlib
import json
import random
import re
import struct
import zlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from cellweave.llm import bytebpe, chat, jaccard, langid, linededup, ogg, packing, quality, queries, tokencount, urlfilter  # noqa: E402
from cellweave.llm.common import connected_components  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, node string, key int"
ODD = [None, "", " ", "\n\n", "a", "'s 't don't  we'll''s \t'x I'LL l'eau'", "x" * 5000, "é" * 300 + "́ ok", "<|endoftext|> a<|endoftext|>", "日本 語　 text 12345 ٣٤", "a \n b\r\n  c   ", "\x1c\x1d a\x1cb \x85 q", "''''s'''ve 'r 're're'll", "🙂🙂 '🙂's", "1's2't 'm", " 'd 's"]


def texts(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(200)]
    for k in range(12):  # near copies at all distances
        words = list(base)
        for _ in range(k):
            words[rng.randrange(200)] = f"z{rng.randrange(9)}"
        rows.append((1000 + k, " ".join(words), "en"))
    rows += [(2000 + k, t, None) for k, t in enumerate(ODD)] + [(5, rows[0][1], "en"), (None, rows[1][1], "en"), (None, None, None)]
    rows.append((3000, " ".join(f"w{rng.randrange(4000)}," for _ in range(20000)), "en"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = texts(spark)
    return rows, spark.createDataFrame([(i, t, g, "s", len(t or ""), 1, "n", 2) for i, t, g in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 11), (None, 3)], "src long, dst long")
    got = {r.node: r.label for r in connected_components(edges).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 11: 2, 8: 8, 9: 8, 7: 7}
    assert connected_components(edges.limit(0)).count() == 0


def shingle_set(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_jaccard(docs, k, num):
    rows, df = docs
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, k=k, num=num).collect()), key=str)
    sets = [shingle_set(t, k) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= num * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _, _) in enumerate(rows)), key=str)
    assert got == want
    kept = jaccard.drop_near_duplicates(df, k=k, num=num)
    assert kept.columns == df.columns
    assert kept.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).count() == len({find(i) for i, s in enumerate(sets) if s})


def test_jaccard_hot_group(spark):
    """A group of near copies around a base that isn't there: exact components without comparing to one leader only."""
    rng = random.Random(5)
    base, rows = [f"b{i}" for i in range(150)], []
    for d in range(400):
        words = list(base)
        for _ in range(rng.randrange(2, 6)):
            words[rng.randrange(150)] = f"z{rng.randrange(50)}"
        rows.append((d, " ".join(words)))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=90).collect()}
    sets, parent = [shingle_set(t, 3) for _, t in rows], list(range(400))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(400):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(400)}


def test_packing(docs):
    rows, df = docs
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    got = packing.pack_documents(df, path).collect()
    want = []
    for d, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        at, k, size = 0, 0, len(ids) % 1024 or 1024
        while at < len(ids):
            want.append((d, k, at, size, zlib.crc32(struct.pack(f"<{size}I", *ids[at : at + size]))))
            at, k, size = at + size, k + 1, 1024
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for o, n in sorted(b):
            assert o == end
            end += n
        assert end <= 1024
    assert len(bins) <= -(-sum(w[3] for w in want) // 1024) * 1.02 + 1


def test_packing_program():
    import numpy as np

    rng = np.random.default_rng(1)
    for case in range(3):
        h = np.bincount(rng.integers(1, [1024, 400, 60][case], 20000), minlength=1025)
        plan = packing.round_program(h, packing.configuration_program(h, 1024, rounds=200), 1024)
        used = np.zeros(1025, int)
        for config, n in plan:
            assert sum(config) <= 1024 and n > 0
            for x in config:
                used[x] += n
        assert (used == h).all()
        assert sum(n for _, n in plan) <= -(-int((h * np.arange(1025)).sum()) // 1024) * 1.01 + 2


@pytest.mark.parametrize("items,most", [({400: 1000, 310: 1000}, 752), ({340: 1000, 500: 1000, 515: 1000}, 1336), ({700: 300, 260: 500, 90: 40, 333: 777}, 640)])
def test_packing_without_exact_fillings(items, most):
    """No configuration fills a sequence, and the plan is still the program's."""
    import numpy as np

    h = np.zeros(1025, np.int64)
    h[list(items)] = list(items.values())
    mixture = packing.configuration_program(h, 1024)
    plan = packing.round_program(h, mixture, 1024)
    used = np.zeros(1025, np.int64)
    for config, n in plan:
        np.add.at(used, list(config), n)
        assert sum(config) <= 1024 and n > 0
    total = sum(n for _, n in plan)
    assert (used == h).all() and packing.least_sequences(h, 1024) <= total <= min(most, sum(mixture.values()) + len(mixture))


def test_language(docs, spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op4_language(spark, "/root/testdata/sf0.01").join(big.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(rows) > 200
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    model = langid.fit_languages(docs[1])
    got = {r.doc_id: r for r in langid.predict_languages(docs[1], model).collect()}
    assert got[2000].lang_pred == got[2001].lang_pred == "und" and got[2000].rejected and 0 <= got[0].score <= 1
    none = langid.predict_languages(docs[1], langid.fit_languages(empty(spark)))
    assert {r.lang_pred for r in none.select("lang_pred").distinct().collect()} == {"und"}


def test_language_rejects_junk(spark):
    # Of the small tables, only these have texts enough for dictionaries of nearly equal size, as the margin was calibrated.
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.fit_languages(docs.where(~langid.held_out("doc_id")))
    rng = random.Random(6)
    kinds = {"letters": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшя", "polish": "szcz prze nie wie rz owa ać ski dzi kow łem czy był jak dla ście".split(), "finnish": "kin ssa lla nen tta sta kuu jää mies talo vesi yö ole kun hän".split()}
    rows = [(f"{k} {n} {j}", " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(2, 6))) for _ in range(n))) for k, parts in kinds.items() for n in (300, 1000, 5000) for j in range(5)]
    junk = spark.createDataFrame(rows, "doc_id string, text string")
    assert langid.predict_languages(junk, model).where("not rejected").count() == 0
    assert langid.keep_identified(junk, model).count() == 0
    held = docs.where(langid.held_out("doc_id"))
    assert langid.keep_identified(held, model).count() > 0.98 * held.count()


def test_language_of_copies_is_learned(spark):
    rows = spark.range(6000).select(F.concat(F.lit("some text of number "), F.expr("repeat(char(97 + cast(id % 20 as int)), 9)")).alias("text"), F.lit("xx").alias("lang"))
    rows = rows.unionByName(spark.createDataFrame([("another one", "yy")], "text string, lang string"))
    model = dict(langid.fit_languages(rows, texts=4).dictionaries)
    assert set(model) == {"xx", "yy"} and sum(x.count(b"some text") for x in model["xx"]) == 4


def test_language_of_long_texts_is_learned(spark):
    rows = spark.createDataFrame([("short and sweet", "xx"), ("long and winding " * 3000, "yy")], "text string, lang string")
    model = dict(langid.fit_languages(rows).dictionaries)
    assert set(model) == {"xx", "yy"} and 8000 < sum(map(len, model["yy"])) <= 8192


def test_quality(docs):
    rows, df = docs
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.score_quality(df, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    want = set()
    for d, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, cover = {}, set()
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                cover |= {i + j for i in at for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.add((d, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(words) < 20 or 100 * len(cover) > 30 * len(words)))
    assert got == want


def test_line_dedup(spark, docs):
    rows = [(1, "alpha beta gamma delta one two three\nown line of one\nuser 17 logged in from 10.0.0.1 ok"), (2, "user 99 logged in from 10.0.0.7 ok\nalpha beta gamma delta one two three\nown line of two here"), (3, "a b c d e f g h i j k l m n o p q r s t\n\nkeep"), (4, "a b c d e f g h i j k l m n o p X r s t\n"), (4, "again"), (None, "keep"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text, r.n_dropped) for r in linededup.dedup_lines(df).collect())
    want = [("1", rows[0][1], 0), ("2", "own line of two here", 2), ("3", rows[2][1], 0), ("4", "", 1), ("4", "again", 0), ("None", "keep", 0), ("5", None, 0), ("6", "", 0)]
    assert got == sorted(want, key=lambda x: (x[0], x[1] or "")) or got == sorted(want, key=str)
    # Exact recurring lines of the sample, by brute force over masked lines.
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    first, out = {}, {r.doc_id: r.text for r in linededup.dedup_lines(real, similarity=1.01).collect()}
    data = sorted((r.doc_id, r.text) for r in real.collect())
    for d, t in data:
        for line in t.split("\n"):
            first.setdefault(linededup.parse_line(line.encode())[0], d)
    for d, t in data:
        parse = [(x, *linededup.parse_line(x.encode())) for x in t.split("\n")]
        assert out[d] == "\n".join(x for x, h, tokens in parse if not tokens or first[h] == d)
    assert linededup.dedup_lines(empty(spark)).count() == 0
    deep = linededup.dedup_lines(spark.createDataFrame([(k, f"same four words here then x{chr(97 + k % 25)}{chr(97 + k % 50 // 25)} b c d e f g h i j k l m n") for k in range(100)], "doc_id long, text string"), similarity=0.99, leaf_lines=8)
    assert deep.where("n_dropped = 1").count() == 50


def test_line_dedup_compares_true_tokens(spark):
    import xxhash

    # Words whose hashes agree in their low 16 bits, pair by pair.
    seen, pairs = {}, []
    for k in range(4000):
        w = f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}"
        low = xxhash.xxh3_64_intdigest(w.encode()) & 0xFFFF
        if low in seen:
            pairs.append((seen.pop(low), w))
        else:
            seen[low] = w
    assert len(pairs) >= 10
    a, b = zip(*pairs[:10])
    rows = [(1, "\n".join([*a, " ".join(a[:6]), "one two three four five " + " ".join(a[:5])])), (2, "\n".join([*b, " ".join(b[:6]), "one two three four five " + " ".join(b[:5])]))]
    got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (t, 0) for i, t in rows}


def test_line_dedup_is_the_same_at_every_size(spark):
    # One varied word at place 6 of 19, in more lines than leaf_lines.
    name = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(4))
    rows = [(k, f"same four words here then {name(k)} b c d e f g h i j k l m n") for k in range(4500)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("n_dropped = 1").count() == 4499
    # Leaves of mixed lines against the rule itself, with and without keys.
    rng = random.Random(5)
    bases = [[rng.choice("pqrst") for _ in range(n)] for n in (7, 12, 12, 20, 33) for _ in range(4)]
    rows = []
    for k in range(600):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = rng.choice("pqrstuv")
        rows.append((k, " ".join(["one", "two", "three", "four", *words])))
    first, heads = {}, {}
    for h, tokens in sorted(((h - (h >> 63 << 64), t) for h, t in {linededup.parse_line(t.encode())[0]: linededup.parse_line(t.encode())[1] for _, t in rows}.items())):
        own = heads.setdefault(len(tokens), [])
        near = [sum(a == b for a, b in zip(tokens, x)) for _, x in own]
        if near and max(near) / len(tokens) >= 0.85:
            first[h] = own[near.index(max(near))][0]
        else:
            own.append((h, tokens))
            first[h] = h
    least, of = {}, {}
    for k, t in rows:
        h = linededup.parse_line(t.encode())[0]
        of[k] = first[h - (h >> 63 << 64)]
        least.setdefault(of[k], k)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for many in (1, 5, 4096):
        assert {r.doc_id for r in linededup.dedup_lines(df, leaf_lines=many).where("n_dropped = 1").collect()} == {k for k, t in of.items() if least[t] != k}
    assert sum(map(len, heads.values())) > 40


def test_token_count(docs):
    rows, df = docs
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    want = sorted(((d, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows), key=str)
    for chunk, overlap in ((32768, 512), (300, 16)):
        got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(df, path, chunk=chunk, overlap=overlap).collect()), key=str)
        assert got == want


def test_byte_bpe(docs):
    import tiktoken

    rows, df = docs
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(((d, lib.encode_ordinary(t or "")) for d, t, _ in rows), key=str)
    got = bytebpe.decode_bpe(bytebpe.encode_bpe(df, path), path).collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=str) == want
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t, _ in rows)
    rng = random.Random(2)
    bpe = bytebpe.codec(path)
    for _ in range(3000):
        t = "".join(rng.choice("a'stmdrevl  \n\t.1é'’🙂S") for _ in range(rng.randrange(1, 25)))
        assert bpe.encode(t)[0] == lib.encode_ordinary(t), repr(t)


def test_ogg(spark):
    rng = random.Random(4)
    for n in (0, 1, 255, 4096, 4080 * 2, 65025, 300000):
        payload = rng.randbytes(n)
        for streams, size in ((1, 4096), (2, 255), (3, 100000)):
            media = ogg.write_ogg(payload, streams, size)
            packets = ogg.read_ogg(media)
            assert ogg.payload_of(packets) == payload
            assert max((p.granule or 0) for p in packets) == n
    bad = bytearray(ogg.write_ogg(b"abc" * 99))
    bad[60] ^= 1
    with pytest.raises(ValueError):
        ogg.read_ogg(bytes(bad))
    assert ogg.page_checksum(b"123456789") == 0x89A1897F  # CRC-32 with that polynomial, from 0, not mirrored
    df = ogg.encode_ogg(spark.createDataFrame([(1, bytearray(b"xyz")), (2, None)], "doc_id long, p binary"), "p")
    assert ogg.decode_ogg(df).where("error is null and number > 0").count() == 1
    row = queries.op9_ogg_media(spark, SF).where("doc_id = 0").head()
    text = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id = 0").head().text.encode()
    text += bytes(-len(text) % 64)
    assert row.payload_sha256 == hashlib.sha256(text).hexdigest() and row.tail_crc32 == zlib.crc32(text[-64:])


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "user", "\\ [INST] </s> ]"), (2, 0, "tool]", "x"), (2, 0, None, "y"), (None, 1, "assistant", "[ROLE=a] \\"), (3, 0, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest_chat(chat.format_chat(df)).collect()}
    for c in (1, 2, 3, None):
        own = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == c))
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got[1].valid and not got[2].valid and not got[3].valid  # the first ends on an unanswered turn
    t = chat.Template()
    rng = random.Random(1)
    for _ in range(2000):
        x = "".join(rng.choice(["[INST]", "[/INST]", "</s>", "<s>", "[ROLE=", "]", "\\", "[", "S", "\n", "[SYS]"]) for _ in range(6))
        assert t.unescape(t.escape(x)) == x and not any(c in t.escape(x) for c in t.controls)
    out = queries.op1_chat_format(spark, SF)
    assert out.where("conv_id = -7 and loss_chars = 21 and n_turns = 2").count() == 1
    assert chat.digest_chat(chat.format_chat(df.limit(0))).count() == 0


def test_urls(spark):
    html = '<link rel="canonical" href="{}">'
    rows = [(1, "http://a.example.com/en/x", ""), (2, "https://b.org/p#f", html.format("http://a.example.com/en/x")), (3, "https://c.org/q", '<meta http-equiv="refresh" content="0; url=https://b.org/p">'), (4, "https://www.example.com/en/z", html.format("https://b.org/p")), (5, None, None), (6, "nourl", None), (7, "http://M.TT.net/fr/a?b", None), (8, "http://d.org/", html.format("/k")), (9, "http://e.org/1", html.format("https://x.net/es/gone")), (9, "http://e.org/1", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(df.where("page_id <> 4"), queries.RULES).collect())
    assert got[0] == (1, "a.example.com", "/en/x", "example.com/en/", "block")
    assert [g[4] for g in got] == ["block", "block", "block", "allow", "allow", "block", "allow", "block", "block"]
    assert got[3][1:4] == ("", "", None) and got[5][1:4] == ("m.tt.net", "/fr/a", "net/fr/")
    allowed = {r.page_id: r.verdict for r in urlfilter.filter_urls(df, queries.RULES).collect()}
    assert allowed[2] == allowed[3] == allowed[4] == "allow" and allowed[1] == "block"


def test_empty_tables(spark):
    e = empty(spark)
    assert jaccard.jaccard_components(e).count() == 0 and jaccard.drop_near_duplicates(e).count() == 0
    assert packing.pack_documents(e, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert quality.keep_quality(e, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert tokencount.count_tokens(e, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert bytebpe.encode_bpe(e, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).count() == 0
    assert urlfilter.filter_urls(e.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("lang").alias("html")), queries.RULES).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline

    frames = [docs[1]]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).persist())
        if name != "best_fit_packing":
            assert frames[-1].columns == docs[1].columns
    n = [f.count() for f in frames]
    assert n[0] >= n[1] >= n[2] >= n[3] >= n[4] > 0
    ids = {r.doc_id for r in frames[4].select("doc_id").collect()}
    assert ids == {r.doc_id for r in frames[5].select("doc_id").collect()}
    assert json.dumps(sorted(i for i in ids if i is not None))
