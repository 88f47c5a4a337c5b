"""The pipeline's stages in a row against plain Python versions of each; odd names of columns; verdicts of the quality rules."""

import random
import re
import zlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from cellweave.llm import jaccard, langid, linededup, packing, quality, tokencount  # noqa: E402
from cellweave.llm.common import Memo, connected_components, materialize  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain_quality(text, model, rules):
    """The verdict by plain loops, without memos."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    cover = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)} if len(grams) < 3000 else None
    if len(words) < 20 or cover is not None and 100 * len(cover) > 30 * len(words):
        return False
    ids = [i for w in words for i in model.encode(w)]
    chars = sum(map(len, words))
    share = sum(model.is_byte(i) for i in ids) / len(ids)
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    entropy = -(p * np.log2(p)).sum()
    band = rules.bands.get(quality.script_of(text), rules.default)
    return bool(band.chars[0] <= chars / len(ids) <= band.chars[1] and share <= band.fallback and entropy >= band.least_entropy(len(ids)) - 1e-12)


def plain_margin(text, model):
    import zstandard

    if not re.search(r"[^\W\d_]", text or ""):
        return 0.0
    data = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
    sizes = []
    for _, parts in model.dictionaries:
        own = []
        for content in parts:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.append(len(zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data)))
        sizes.append(sorted(own)[len(own) // 2])
    a, b = sorted(sizes)[:2]
    return (b - a) / b


def plain_lines(rows, depth=4, similarity=0.85):
    """Texts without recurring templates: every line is compared with all heads of its leaf, in order of its number."""
    parsed = {}
    for _, text in rows:
        for line in (text or "").encode().split(b"\n"):
            h, tokens = linededup.parse_line(line)
            if tokens:
                parsed[h - (h >> 63 << 64)] = tokens
    leaves, template = {}, {}
    for h, tokens in sorted(parsed.items()):
        heads = leaves.setdefault((len(tokens), *tokens[:depth]), [])
        best = max(((sum(a == b for a, b in zip(tokens, t)), -k) for k, (_, t) in enumerate(heads)), default=(0, 0))
        if heads and best[0] / len(tokens) >= similarity and len(tokens) > depth:
            template[h] = heads[-best[1]][0]
        else:
            heads.append((h, tokens))
            template[h] = h
    first, out = {}, {}
    lines = {d: [(x, *linededup.parse_line(x.encode())) for x in (t or "").split("\n")] for d, t in rows}
    key = lambda h: template[h - (h >> 63 << 64)]
    for d, _ in sorted(rows):
        for _, h, tokens in lines[d]:
            if tokens:
                first.setdefault(key(h), d)
    for d, text in rows:
        kept = [x for x, h, tokens in lines[d] if not tokens or first[key(h)] == d]
        if any(tokens for _, _, tokens in lines[d]) and not any(x.strip(" \t\n\r\x0b\x0c") for x in kept):
            continue
        out[d] = "\n".join(kept)
    return out


def plain_survivors(rows):
    sets = []
    for d, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
        sets.append((d, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(d), find(e)))
                parent[y] = x
    return {d for d in parent if find(d) == d}


def test_stages_in_a_row(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rules = quality.FertilityRules()
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).persist())
    kept = {r.doc_id for r in frames[1].collect()}
    assert kept == {d for d, r in rows.items() if plain_quality(r.text, model, rules)}
    fitted = langid.fit_languages(frames[1].where(~langid.held_out("doc_id")))
    known = {r.doc_id: r.text for r in frames[2].collect()}
    assert set(known) == {d for d in kept if plain_margin(rows[d].text, fitted) > langid.MIN_MARGIN}
    thinned = {r.doc_id: r.text for r in frames[3].collect()}
    assert thinned == plain_lines(sorted(known.items()))
    assert {r.doc_id for r in frames[4].collect()} == plain_survivors(sorted(thinned.items()))
    packed = frames[5].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in frames[4].collect()}
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == np.cumsum([0, *(n for _, n in sorted(b))]).tolist()[:-1] and sum(n for _, n in b) <= 1024


def test_margins_and_sizes_by_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_languages(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.predict_languages(docs, model).collect():
        assert abs(r.margin - plain_margin(texts[r.doc_id], model)) < 1e-12 and 0 <= r.score <= 1


def test_quality_verdicts(spark):
    """Labelled documents of good quality stay; texts of bytes, of one word, and of words without sense go, whatever the script."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = quality.score_quality(docs, path).join(docs.select("doc_id", "quality"), "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert len(good) > 50 and sum(good) / len(good) > 0.97
    fine = {
        "cyrillic": "Каждое утро старый рыбак выходил к морю и долго смотрел на серую воду, пока солнце медленно поднималось над далёкими скалами. Потом он чинил сети, варил чай и рассказывал внукам о том, какие бури видел в молодости, когда ещё ходил на большом корабле.",
        "greek": "Κάθε πρωί ο γέρος ψαράς κατέβαινε στη θάλασσα και κοίταζε για ώρα το γκρίζο νερό, ενώ ο ήλιος ανέβαινε αργά πάνω από τα μακρινά βράχια. Ύστερα έφτιαχνε τα δίχτυα του και έλεγε στα εγγόνια του ιστορίες για τις φουρτούνες που είχε ζήσει.",
        "hebrew": "בכל בוקר ירד הדייג הזקן אל הים והביט שעה ארוכה במים האפורים בזמן שהשמש עלתה לאט מעל הסלעים הרחוקים אחר כך תיקן את הרשתות בישל תה וסיפר לנכדיו על הסערות שראה בצעירותו כאשר עוד הפליג באונייה גדולה",
    }
    bad = {
        "one word": "word " * 400,
        "bytes": " ".join("".join(chr(random.Random(k).randrange(0x460, 0x480)) for k in range(j, j + 6)) for j in range(60)),
        "digits": " ".join(str(k) for k in range(300)),
        "two words": "да нет " * 300,
    }
    table = spark.createDataFrame([(n, t) for n, t in (fine | bad).items()], "doc_id string, text string")
    got = {r.doc_id: (r.kept, r.script) for r in quality.score_quality(table, path).collect()}
    assert {n: got[n] for n in fine} == {n: (True, n) for n in fine}
    assert not any(got[n][0] for n in bad)
    assert {r.doc_id for r in quality.keep_quality(table, path).collect()} == set(fine)


def test_columns_with_clashing_names(spark):
    rows = [(k, f"one two three four five six seven eight number {k % 3}\nthe same line of all the documents here", "a") for k in range(6)] + [(None, None, "b"), (7, "", "c")]
    names = ["doc", "DROP", "rid", "__doc", "__drop", "__rid", "line", "key", "salt", "Rank", "before", "__salt", "n", "node", "label"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for n in names:
        df = df.withColumn(n, F.lit(5))
    assert sorted(linededup.dedup_lines(df).columns) == sorted([*df.columns, "n_lines", "n_dropped"])
    assert linededup.dedup_lines(df).where("__doc = 5 and `DROP` = 5").count() == len(rows)
    kept = jaccard.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.where("__rid = 5 and rid = 5").count() == kept.count() == 5
    items = spark.createDataFrame([(k, 0, 1 + k % 9) for k in range(100)], "doc_id long, piece int, length long")
    for n in names:
        items = items.withColumn(n, F.lit(5))
    out = packing.pack(items, 16)
    assert out.columns == [*items.columns, "sequence_id", "offset"] and out.where("__salt = 5 and salt = 5 and `Rank` = 5").count() == 100


def test_repeated_rows_stay_once(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (1, text), (1, text), (2, text), (3, "other words " * 20), (3, "other words " * 20), (4, ""), (4, ""), (None, text)]
    kept = jaccard.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, text), (3, "other words " * 20), (4, ""), (4, "")], key=str)


def test_similarity_of_passages_and_sizes(spark):
    """Documents that share a long passage but little else, chains of near copies and sets of very unequal sizes, against brute force."""
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(70)]
    rows = []
    for d in range(160):
        own = [f"d{d}w{k}" for k in range(rng.randrange(5, 60))]
        rows.append((d, " ".join(own[:3] + passage + own[3:])))
    for c in range(6):
        base = [f"c{c}x{k}" for k in range([30, 60, 120, 250, 500, 1000][c])]
        for d in range(25):
            for _ in range(max(1, len(base) // 60)):
                base[rng.randrange(len(base))] = f"y{rng.randrange(1000)}"
            rows.append((1000 + 100 * c + d, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, k=5, num=80).collect()}
    sets = [(d, {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(d), find(e)))
                parent[y] = x
    assert got == {d: find(d) for d in parent}
    assert len(set(got.values())) > 50


def test_components_take_few_rounds(spark, monkeypatch):
    from cellweave.plans import components

    n, rounds = 1024, []
    monkeypatch.setattr(components, "written", lambda df, own=components.written: rounds.append(1) or own(df))
    order = list(range(0, n, 2)) + list(range(n - 1, 0, -2))  # numbers rise from both ends
    edges = spark.createDataFrame(list(zip(order, order[1:])), "src long, dst long")
    got = components.connected_components(edges)
    assert {r.label for r in got.collect()} == {0} and got.count() == n and len(rounds) <= 20
    assert connected_components is components.connected_components


def test_texts_without_blanks_are_counted(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, rng = Tokenizer.from_file(path), random.Random(2)
    signs = ["abcXYZ0123456789+/", "日本語文章の書き方", "a'sdtllve1", "éäo1", "x", "<|endoftext|>ab1'", "İi1ßﬁ²"]
    for alphabet in signs:
        text = "".join(rng.choice(alphabet) for _ in range(6000)) if alphabet != "x" else "x" * 6000
        want = len(lib.encode(text, add_special_tokens=False).ids)
        for chunk, overlap in ((400, 16), (1000, 64)):
            assert tokencount.count_long(lib, text, chunk, overlap) == want, alphabet


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_of_every_vocabulary(name):
    """Sums over words and splices only where the file's pre-tokeniser allows them."""
    path, rng = public_tokenizers.path(name), random.Random(8)
    library = tokencount.load_tokenizer(path)[0]
    texts = ["hello world foo  bar", "a\n\nb  c\tdef ghi", "", " ", "\u3000x\x1cy", "<|endoftext|> a <|endoftext|>", " lead and trail \n", "Don't I'LL we're", "é" * 300, "1 2  3   4"]
    texts += ["".join(rng.choice("ab é1'.,\n\t  日") for _ in range(n)) for n in (50, 900, 5000)]
    want = [len(library.encode(t) if name.endswith(".model") else library.encode(t, add_special_tokens=False).ids) for t in texts]
    for chunk, overlap in ((32768, 512), (300, 16)):
        assert tokencount.count_texts(path, texts, chunk, overlap) == want
    assert (tokencount.load_tokenizer(path)[1] is not None) == (name == "word_bpe_49k.json")
    with pytest.raises(ValueError):
        tokencount.load_tokenizer("a.tiktoken")


def test_packing_bound():
    rng = np.random.default_rng(4)
    for top in (1024, 500, 90):
        h = np.bincount(rng.integers(1, top, 5000), minlength=1025)
        plan = packing.round_program(h, packing.configuration_program(h, 1024, rounds=150), 1024)
        used, bound = sum(n for _, n in plan), packing.least_sequences(h, 1024, (np.arange(1025) / 1024) ** 1.2)
        assert bound <= used <= bound * 1.05 + 2
    assert zlib.crc32(b"") == 0


def sent(run):
    """What a task gets of a nested function: a copy that goes through Spark's pickle."""
    from pyspark import cloudpickle

    return cloudpickle.loads(cloudpickle.dumps(run))


class Table:
    """Gives the function that an operator maps over batches."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_a_worker_loads_the_vocabulary_once(spark):
    import pyarrow as pa

    run = packing.cut_pieces(Table(spark.range(1).schema), public_tokenizers.path("byte_bpe_50k.json"), 8, 2, id_col="id")
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words of a text", None]})
    first = [b.to_pydict() for b in sent(run)([batch])]
    held = len(Memo.every)
    for _ in range(3):  # further tasks
        assert [b.to_pydict() for b in sent(run)([batch])] == first
    assert len(Memo.every) == held


@pytest.mark.parametrize("make", [lambda: jaccard._signatures(5), lambda: jaccard._keys(5, 80, 100), lambda: jaccard._sets(5)])
def test_a_worker_keeps_the_bounds_of_the_word_memo(monkeypatch, make):
    import pyarrow as pa

    Memo.focus()
    monkeypatch.setattr(jaccard.WORDS, "limit", 50)
    text = " ".join(f"w{k}" for k in range(500))
    list(sent(make())([pa.RecordBatch.from_pydict({"doc": [1], "rid": [1], "text": [text]})]))
    assert len(jaccard.WORDS) <= 50


def test_keys_meet_only_where_members_do():
    """Sets without a common member share no key, however many sets there are: what is fetched and compared follows the links."""
    rng = np.random.default_rng(3)
    bands = jaccard.Bands(80, 100)
    keys = [np.unique(jaccard.sketch_keys(np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64)), bands)) for _ in range(2000)]
    every = np.concatenate(keys)
    assert len(np.unique(every)) == len(every)


def test_many_rows_go_by_bitmap(spark):
    """More rows go than Spark broadcasts; the rest stays whole, repeated rows once, rows without words all."""
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = F.concat_ws(" ", *(F.concat(F.lit(f"a{k}x"), (F.col("id") % 40).cast("string")) for k in range(12)))
        docs = spark.range(400).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("x").alias("word"))
        docs = docs.union(docs.where("doc_id in (3, 45)")).union(spark.sql("select id, ' ', 'x' from range(900, 903)")).union(spark.sql("select 900L, ' ', 'x'"))
        got = jaccard.drop_near_duplicates(materialize(docs))
        assert got.columns == docs.columns
        assert sorted(r.doc_id for r in got.collect()) == [*range(40), 900, 900, 901, 902]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
