"""Ogg files against a plain reader, cut at every place; URL verdicts against a plain union-find over random graphs; chat states."""

import hashlib
import random
import struct
import zlib
from urllib.parse import urljoin, urlsplit

import duckdb
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from cellweave.llm import chat, ogg, queries, urlfilter  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain_crc(data):
    out = 0
    for byte in data:
        out ^= byte << 24
        for _ in range(8):
            out = (out << 1 ^ 0x04C11DB7 if out & 0x80000000 else out << 1) & 0xFFFFFFFF
    return out


def plain_pages(media):
    """(serial, flags, granule, packets' pieces) of each page, and its end."""
    at = 0
    while at < len(media):
        assert media[at : at + 5] == b"OggS\x00"
        flags, granule, serial, _, crc, n = struct.unpack_from("<BqIIIB", media, at + 5)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if end - at < 700:  # the slow sum, where it is quick
            assert plain_crc(media[at : at + 22] + bytes(4) + media[at + 26 : end]) == crc
        yield serial, flags, granule, lacing, media[at + 27 + n : end], end
        at = end


def plain_payload(media):
    packets, open_ = {}, {}
    for serial, _, _, lacing, body, _ in plain_pages(media):
        pos = 0
        for size in lacing:
            open_[serial] = open_.get(serial, b"") + body[pos : pos + size]
            pos += size
            if size < 255:
                packets.setdefault(serial, []).append(open_.pop(serial))
    lists = [packets[s][1:] for s in sorted(packets)]
    return b"".join(x[k] for k in range(max(map(len, lists))) for x in lists if k < len(x))


def test_every_row_of_the_media_query(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_ogg_media(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        payload = texts[r.doc_id] + bytes(-len(texts[r.doc_id]) % 64 or (0 if texts[r.doc_id] else 64))
        media = ogg.write_ogg(payload)
        assert plain_payload(media) == payload
        want = (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == want
        assert r.feature.startswith("2 streams, ") and f"peak {max(payload)}" in r.feature


@pytest.mark.parametrize("size", [64, 5000, 102400])
def test_files_cut_anywhere_are_damaged(size):
    payload = random.Random(size).randbytes(size)
    media = ogg.write_ogg(payload)
    ends = [end for *_, end in plain_pages(media)]
    assert ogg.payload_of(ogg.read_ogg(media)) == payload
    for cut in {*ends[:-1], *(e - 1 for e in ends), *(e + 5 for e in ends[:-1])}:
        with pytest.raises(ValueError):
            ogg.read_ogg(media[:cut])
    starts = [0, *ends]
    for a, b in zip(starts, ends):  # any page left out
        with pytest.raises(ValueError):
            ogg.read_ogg(media[:a] + media[b:])
    assert ogg.read_ogg(b"") == []


def test_damaged_files_in_a_table(spark):
    media = ogg.write_ogg(b"x" * 9000)
    rows = [(1, bytearray(media)), (2, bytearray(media[:100])), (None, None), (3, bytearray()), (1, bytearray(media))]
    got = ogg.decode_ogg(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert {(r.id, r.error) for r in got} == {(1, None), (2, "short page"), (None, "empty"), (3, "empty")}
    assert sum(r.id == 1 for r in got) == 2 * len(ogg.read_ogg(media)) and sum(r.id == 2 for r in got) == 1


def node(url):
    host = urlsplit(url).netloc.lower()
    path = urljoin("http://h/", urlsplit(url).path or "/")[len("http://h") :]
    return host, path, urlsplit(url).query


def test_verdicts_over_random_graphs(spark):
    rng = random.Random(8)
    hosts = ["a.org", "b.org", "c.net", "www.example.com", "x.example.com", "m.net", "d.io", "e.io"]
    for _ in range(3):
        rows = []
        for k in range(400):
            url = f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/es/', '/fr/', '/p/q/'])}"
            url = url if url.count("/") < 3 else url + rng.choice([f"n{rng.randrange(60)}", f"n{rng.randrange(60)}?i={rng.randrange(3)}", ""])
            to = rng.choice([f"n{rng.randrange(60)}", f"../n{rng.randrange(60)}", f"./n{rng.randrange(60)}", f"/en/n{rng.randrange(60)}", f"//{rng.choice(hosts)}/es/n{rng.randrange(60)}", f"https://{rng.choice(hosts).upper()}/en/../fr/n{rng.randrange(60)}#f", f"?i={rng.randrange(3)}", "#here", "mailto:x@y", f"n{rng.randrange(60)}?i=1&amp;j=2"])
            tag = rng.choice(['<link rel="canonical" href="{}">', "<LINK href='{}' rel=canonical>", '<meta http-equiv="refresh" content="0; url={}">', '<link rel="next" href="{}">', "<p>"])
            rows.append((k, rng.choice([url, url, url, url, None, "no address"]), rng.choice([None, tag.format(to), tag.format(to)])))
        parent = {}

        def find(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        rules = sorted(queries.RULES, key=lambda r: -len(r[1] + r[2]))

        def own(url):
            host, path = urlsplit(url).netloc.lower(), urlsplit(url).path
            return next(((h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), None)

        votes, targets = {}, []
        for _, url, html in rows:
            if url and "://" in url:
                find(node(url))
                if html and ("canonical" in html or "refresh" in html):
                    ref = html.split("url=")[1].split('"')[0] if "refresh" in html else html.split("href=")[1][1:].split(html.split("href=")[1][0])[0]
                    ref = ref.replace("&amp;", "&")
                    if not ref.startswith("mailto:"):
                        to = urljoin(url, ref)
                        targets.append(to)
                        parent[find(node(url))] = find(node(to))
            elif html and "HTTPS://" in html.upper() and ("canonical" in html or "refresh" in html):
                pass  # a page without an address is no node
        linked = {find(x) for x in parent if find(x) != x}
        for url in [u for _, u, _ in rows if u and "://" in u] + targets:
            if own(url):
                votes.setdefault(find(node(url)), set()).add(own(url)[1])
        want = {}
        for k, url, _ in rows:
            if not url or "://" not in url:
                want[k] = (None, "allow")
                continue
            rule = own(url)
            root = find(node(url))
            want[k] = rule or (None, "block" if root in linked and votes.get(root) == {"block"} else "allow")
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.filter_urls(df, queries.RULES).collect()}
        assert got == want
        con = duckdb.connect()
        con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
        con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
        assert {r[0]: (r[3], r[4]) for r in con.execute(queries.oracle_sql()["op10_url_filter"]).fetchall()} == want
        assert any(v == (None, "block") for v in want.values())


def test_pages_without_an_address_share_nothing(spark):
    html = '<link rel="canonical" href="http://x.net/es/gone">'
    rows = [(1, None, html), (2, None, None), (3, "nourl", html), (4, "other", None), (5, "http://h.org", '<link rel="canonical" href="http://h.org/">'), (6, "http://h.org/", html)]
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.RULES).collect()}
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "block"}


def test_chat_ends_in_a_final_state(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "system", "s"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", "c")]
    segments = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: r.valid for r in chat.digest_chat(segments).collect()} == {1: False, 2: False, 3: True, 4: False}
    # A stored table, read in another order, has the same digests; as it comes, it raises.
    moved = segments.orderBy("segment", "text").coalesce(1)
    assert sorted(chat.digest_chat(moved).collect()) == sorted(chat.digest_chat(segments, in_order=True).collect())
    with pytest.raises(Exception, match="out of order"):
        chat.digest_chat(moved, in_order=True).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, got.select(*names).toPandas().itertuples(index=False, name=None))) == sorted(map(str, want.fetchdf().itertuples(index=False, name=None)))


def test_codec_heads(spark):
    """Times of real codecs' streams, from heads written by hand after their specifications."""
    heads = {
        "opus": (b"OpusHead" + struct.pack("<BBHIhB", 1, 2, 312, 44100, 0, 0), 48312, 1.0),
        "vorbis": (b"\x01vorbis" + struct.pack("<IBIiiiBB", 0, 2, 44100, 0, 128000, 0, 0xB8, 1), 88200, 2.0),
        "flac": (b"\x7fFLAC\x01\x00\x00\x01fLaC\x00\x00\x00\x22" + struct.pack(">HH", 4096, 4096) + bytes(6) + ((96000 << 12) | (1 << 9) | (15 << 4)).to_bytes(4, "big") + bytes(20), 48000, 0.5),
        "speex": (b"Speex   " + b"1.2".ljust(20, b"\0") + struct.pack("<iii", 1, 80, 16000) + bytes(40), 4000, 0.25),
    }
    rows = []
    for k, (codec, (head, granule, seconds)) in enumerate(heads.items()):
        media = b"".join(page for _, page in ogg._stream(k + 1, [(head, 0), (b"tags", 0), (b"sound" * 99, granule)]))
        last = ogg.read_ogg(media)[-1]
        assert (last.codec, last.granule, last.seconds) == (codec, granule, seconds)
        rows.append((k, bytearray(media)))
    assert ogg.clock_of(b"theora?") is None
    for broken in (b"OpusHead\x01", b"\x01vorbis", heads["speex"][0][:36] + bytes(44), b"\x7fFLAC\x01\x00\x00\x01flac" + bytes(40)):
        with pytest.raises(ValueError):
            ogg.clock_of(broken)
    frame = spark.createDataFrame([(i, m, "a", 1) for i, m in rows], "doc_id long, media binary, `x.y` string, id int")
    got = {r.id: r.seconds for r in ogg.decode_ogg(frame).where("number = 2").collect()}
    assert got == {k: v[2] for k, v in enumerate(heads.values())}
    again = ogg.encode_ogg(frame.withColumnRenamed("media", "payload"), "payload", "media")
    assert again.columns == ["doc_id", "payload", "x.y", "id", "media"] and ogg.decode_ogg(again).where("error is not null").count() == 0


def test_rules_as_a_table(spark):
    """A long list, a table and the compiled form give the same."""
    rules = queries.RULES + [("block", "a.b.com", "/"), ("allow", "a.b.com", "/"), ("block", "b.com", "/x"), ("block", "", "/"), ("allow", "b.com:80", "/")]
    urls = ["http://a.b.com/", "http://z.a.b.com/x/y", "https://b.com/xyz", "http://b.com:80/x", "http://example.com/en/1", "http://www.example.com/en/1", "http://.com/", "nothing", None, "http://Q.NET/es/", "http:///", "http://xb.com/x"]
    page = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls + urls[:3])], "page_id long, url string, html string")
    many = rules + [("block", f"h{k}.org", "/") for k in range(100)]
    read = lambda r: sorted(map(tuple, urlfilter.filter_urls(page, r).collect()))
    plain = page.withColumns({"host": urlfilter.host_of(F.col("url")), "path": urlfilter.path_of(F.col("url"))})
    want = sorted((r.page_id, r.rule, r.verdict) for r in urlfilter.with_rules(plain, many, compiled=1000).select("page_id", "own.*").collect())
    assert sorted((r.page_id, r.rule, r.verdict) for r in urlfilter.with_rules(plain, many).select("page_id", "own.*").collect()) == want
    table = spark.createDataFrame(many, "verdict string, host string, path string")
    assert read(many) == read(table)
    hops = spark.createDataFrame([("http://b.com/x", "http://free.org/", 1), (None, "http://x.org/", 2)], "from_url string, to_url string, _host int")
    assert urlfilter.with_nodes(urlfilter.resolve(hops, "from_url", "to_url", "full"), "full", "node").columns == ["from_url", "to_url", "_host", "full", "node"]
