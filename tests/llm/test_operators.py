"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with odd rows among the input."""

import hashlib
import os
import random
import re
import tracemalloc
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tritlake.llm import decontaminate as dc
from tritlake.llm import html_extract as hx
from tritlake.llm import language_id as li
from tritlake.llm import matroska as mk
from tritlake.llm import mixing as mx
from tritlake.llm import secret_scan as ss
from tritlake.llm import simhash as sh
from tritlake.llm import substring_dedup as sd
from tritlake.llm import suffix_dedup as sx
from tritlake.llm import suffix_induction as si
from tritlake.llm import token_counts as tc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size int, text_lang string"


@pytest.fixture(scope="module")
def texts():
    """Words with copies, near copies and shared passages; nulls, empty, very long and odd texts; repeated ids."""
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdeéñß", k=rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: "".join(w + rng.choice([" ", " ", " ", ". ", "\n"]) for w in rng.choices(vocab, k=n))
    shared = prose(90)
    out = [prose(rng.randint(1, 200)) for _ in range(60)]
    out += [out[3], out[3], out[4] + " x", out[5][:300] + shared + out[6][:50], shared, prose(40) + shared]
    out += [None, "", " \n\t ", "a", "Secret: 'abcdefgh' AKIA" + "A1" * 10, "ab " * 4000, prose(15000), "x" * 450, "\x00é 𝔘 token=zz"]
    rows = [(i, t) for i, t in enumerate(out)] + [(None, "null id row with some words in it"), (7, out[7]), (7, "same id, other text")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    src = ["a", "b", None, "á"]
    rows = [(i, t, ["en", "de", None][k % 3], src[k % 4], k, "clash", k, "clash") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def rows_of(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def test_suffix_arrays_by_induction(monkeypatch):
    rng = np.random.default_rng(0)
    for _ in range(400):
        # Small bounds bring every way of the scans, the naming and the recursion into short strings.
        bounds = {"BLOCK": [2, 3, 7, 1 << 15], "GROUP": [2, 9, 1 << 12], "BUFFER": [1, 5, 1 << 11], "LOOK": [1, 5, 1 << 12], "NAMED": [2, 5, 1 << 18], "MOST_GROUPS": [2, 1 << 11], "IN_MEMORY": [0, 3, 1 << 20]}
        for name, values in bounds.items():
            monkeypatch.setattr(si, name, int(rng.choice(values)))
        x = rng.integers(0, int(rng.integers(1, 8)), int(rng.integers(1, 60)))
        x = np.tile(x[: max(1, len(x) // 4)], 4) if rng.random() < 0.3 else x
        got = [np.concatenate(v).tolist() for v in zip(*si.induce(x.astype(np.uint8), 9), strict=True)]
        t = x.tolist()
        sa = sorted(range(len(t)), key=lambda i: t[i:])
        lcp = [0] + [next((k for k, (p, q) in enumerate(zip(t[a:], t[b:], strict=False)) if p != q), min(len(t) - a, len(t) - b)) for a, b in zip(sa, sa[1:], strict=False)]
        assert got == [sa, lcp]


def test_memory_does_not_follow_the_shard(monkeypatch):
    """With small bounds, four times the text takes little more memory; all repeated stretches are found."""
    for name, value in {"IN_MEMORY": 1 << 13, "NAMED": 1 << 13, "BLOCK": 1 << 13, "WALK": 1 << 14}.items():
        monkeypatch.setattr(si, name, value)
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(2000)]
    peaks = []
    for size in (1 << 18, 1 << 20):
        tracemalloc.start()
        shard, again, k = sx.Shard(), 0, 0
        while shard.size < size:
            if k % 9:
                text = " ".join(rng.choices(words, k=80)).encode()[:336]
            again += not k % 9
            shard.add(k, 0, False, 0, len(text) - 199, text) if k else shard.add(0, 0, False, 0, 137, (text := b"x" + b"y" * 335))
            k += 1
        assert sum(1 for _ in shard.repeated(200)) >= 2 * again - 2 > 20
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0] and peaks[1] < 4 << 20


def removed(texts, width):
    seen = Counter(d[k : k + width] for _, t in texts for d in [(t or "").encode()] for k in range(len(d) - width + 1))
    out = Counter()
    for i, t in texts:
        d = (t or "").encode()
        cover = bytearray(len(d))
        for k in range(len(d) - width + 1):
            if seen[d[k : k + width]] > 1:
                cover[k : k + width] = b"\1" * width
        left = bytes(c for c, m in zip(d, cover, strict=True) if not m)
        out[(i, len(d), sum(cover), len([r for r in bytes(cover).split(b"\0") if r]), hashlib.sha256(left).hexdigest())] += 1
    return out


def test_suffix_array_dedup(docs, texts):
    got = rows_of(sx.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = removed(texts, 200)
    assert sum(k[2] > 0 for k in want) > 8
    assert got == want


def test_suffix_array_dedup_in_small_shards(spark, docs, texts):
    base = docs.select(F.col("doc_id").alias("__id"), F.coalesce("doc_id", F.lit(-1)).alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    key = lambda shard: sorted(set(map(tuple, sx.repeated_spans(base, shard=shard).collect())))
    assert key(1) == key(1 << 22)
    # Strings of hot anchors are folded to digests: the same bytes are covered.
    cover = lambda rows: {(i, h, p) for i, h, s, e in rows for p in range(s, e)}
    for hot in (1, 3):
        assert cover(map(tuple, sx.repeated_spans(base, hot=hot).collect())) == cover(key(1))


def plain_line_dedup(rows, least):
    """{(id, text): (left, lines removed, spans)} by an own splitter: units are runs of lines, the least (id, text digest, place) stays."""
    docs, firsts, seen = [], {}, Counter()
    for i, t in rows:
        t = t or ""
        lines, at = [], 0
        for raw in t.split("\n"):
            words = "".join(c if c == "_" or c.isalnum() or unicodedata.category(c)[0] == "M" else " " for c in raw.lower()).split()
            if words:
                start = at + len(raw) - len(raw.lstrip())
                lines.append((start, at + len(raw.rstrip()), " ".join(words)))
            at += len(raw) + 1
        units = []
        for k in range(len(lines)):
            for m in range(k, len(lines)):
                if sum(len(x[2].encode()) for x in lines[k : m + 1]) >= least:
                    units.append((lines[k][0], lines[m][1], tuple(x[2] for x in lines[k : m + 1])))
                    break
            else:
                if k == 0 and lines:
                    units.append((lines[0][0], lines[-1][1], tuple(x[2] for x in lines)))
                break
        docs.append((i, t, lines, units))
    for i, t, _, units in docs:
        for s, e, u in units:
            seen[u] += 1
            rank = (-(1 << 63) if i is None else i, t, s, e)
            firsts[u] = min(firsts.get(u, rank), rank)
    out = {}
    for i, t, lines, units in docs:
        cover = set()
        for s, e, u in units:
            if seen[u] > 1 and firsts[u] != (-(1 << 63) if i is None else i, t, s, e):
                cover.update(range(s, e))
        out[(i, t)] = ("".join(c for k, c in enumerate(t) if k not in cover), sum(x[0] in cover for x in lines))
    return out


@pytest.mark.parametrize("least", [1, 40, sd.LEAST_BYTES])
def test_substring_dedup(docs, texts, spark, least):
    more = [(800 + k, t) for k, t in enumerate(["Read more\n今日は天気がいい。\nทางซ้าย\nx\n---", "read MORE.\n今日は天気がいい\nทางซาย\nX\n---", "\r\n  Read more \r\nx", "one line of its own\n" * 9])]
    # Of rows with equal ids the text's digest decides, which the plain version does not know.
    rows = [r for r in texts if r[0] != 7] + more
    d = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, s string").repartition(3)
    got = {(r.doc_id, r.text, r.n_removed) for r in sd.drop_repeated_units(d, least_bytes=least).collect()}
    want = plain_line_dedup(rows, least)
    assert got == {(i, left, n) for (i, _), (left, n) in want.items()}
    assert sum(n > 0 for _, n in want.values()) > (20 if least == 1 else 2)
    # Removed spans are places in the original text.
    text = dict((i, t or "") for i, t in rows)
    for r in sd.drop_repeated_units(d, least_bytes=least).filter("n_removed > 0").collect():
        kept, at = "", 0
        for span in r.removed_spans.split(","):
            s, e = map(int, span.split(":"))
            kept, at = kept + text[r.doc_id][at:s], e
        assert kept + text[r.doc_id][at:] == r.text


def test_short_lines_stay_in_other_company(spark):
    passage = "a passage of several short lines\nthat many texts share, so it\nis to go wherever it stands\nand however its lines are cut\nas long as they are the same"
    rows = [(1, "All rights reserved.\nsome words that stand in the first text only, and then some more of them"), (2, "All rights reserved.\nother words, which the second text alone has, up to here and beyond that")]
    rows += [(3, f"one\n{passage}\ntwo"), (4, f"three\n{passage}\nfour"), (5, passage)]
    got = {r.doc_id: (r.text, r.n_removed) for r in sd.drop_repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (dict(rows)[i], 0) for i in (1, 2, 3))
    assert got[4] == ("three\n\nfour", 5) and got[5] == ("", 5)


def test_passages_within_lines_go(spark):
    passage = "It has two sentences, and neither begins a line of any text that holds them. They are long enough together to be a passage of their own, which goes."
    rows = [(1, f"The first text leads in. {passage} And it leads out again."), (2, f"Other words stand before the cut of this one {passage} Nothing follows but this"), (3, "One sentence alone in one line, which is long enough to be a run of lines and of sentences, is no repeat of itself in any text. ")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in sd.drop_repeated_units(d, inside=True).collect()}
    assert got == dict(rows)  # its first sentence is not whole in the second text, and the other is too short
    whole = rows[:1] + [(2, rows[1][1].replace("this one", "this one."))] + rows[2:]
    got = {r.doc_id: (r.text, r.n_removed) for r in sd.drop_repeated_units(spark.createDataFrame(whole, "doc_id long, text string"), inside=True).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("Other words stand before the cut of this one.  Nothing follows but this", 1), 3: (rows[2][1], 0)}


def test_fingerprints_and_components(docs, texts):
    def plain(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        g = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h))

    fp = [(i, plain(t)) for i, t in texts]
    label = list(range(len(fp)))
    while True:
        new = [min(label[b] for b, (_, y) in enumerate(fp) if (x ^ y).bit_count() <= 4) for _, x in fp]
        if new == label:
            break
        label = new
    least = defaultdict(list)
    for k, (i, _) in zip(label, fp, strict=True):
        least[k].append(i)
    want = Counter((i, f"{x:016x}", min((v for v in least[k] if v is not None), default=None)) for k, (i, x) in zip(label, fp, strict=True))
    assert rows_of(sh.find_near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert sh.fingerprint("") == 0


def test_near_links_against_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(40):
        base = rng.integers(0, 2**63, 5, dtype=np.uint64)
        x = base[rng.integers(0, 5, 200)]
        for _ in range(int(rng.integers(0, 7))):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
        x = np.unique(x)
        x = x[np.argsort(sh.gray_rank(x))]
        u, v = sh.links(x, np.zeros(len(x), int))
        mine = np.arange(len(x))
        mine[u] = v
        near, lab = np.bitwise_count(x[:, None] ^ x) <= 4, np.arange(len(x))
        while True:
            new = np.array([lab[row].min() for row in near])
            if (new == lab).all():
                break
            lab = new
        assert len(set(zip(mine.tolist(), lab.tolist(), strict=True))) == len(set(mine.tolist())) == len(set(lab.tolist()))


def test_hot_patterns_are_dealt_again(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    x = base[rng.integers(0, 3, 300)]
    for _ in range(4):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    d = spark.createDataFrame([(int(v),) for v in np.unique(x).view(np.int64)], "fp long")
    # Few rows a pattern: nearly all are dealt twice and three times.
    roots = [Counter(tuple(r) for r in sh.components(sh.near_links(d, group=g)).collect()) for g in (1 << 20, 7, 1)]
    assert roots[0] == roots[1] == roots[2] and len(roots[0]) > 10


def test_html_extraction(spark):
    page = "<html><head><title>t</title></head><body><header>H</header><nav>N</nav>{}<aside>s</aside><footer>&copy;</footer></body></html>"
    shared = "<div>Our shop is open daily</div><p>{}</p><div>All rights kept</div>"
    art = "<article><h1>T &amp; x</h1><p>a  b<br>c<p>d <script>e</script><div class='comments'>zz</div></article>"
    rows = [
        (1, "http://h.com/a/1", page.format(art)), (2, "http://h.com/a/2", page.format(shared.format("one"))), (3, "http://h.com/a/3", page.format(shared.format("two"))),
        (4, "http://g.com/x", page.format(shared.format("alone"))), (5, None, None), (None, "u", ""), (3, "http://h.com/a/3", page.format(shared.format("two"))), (6, "x", "<p>plain <b>text"),
    ]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    got = rows_of(hx.extract_pages(d), "page_id", "text", "n_chars")
    alone = "Our shop is open daily\n\nalone\n\nAll rights kept"
    texts = [(1, "T & x\n\na b c\n\nd"), (2, "one"), (3, "two"), (3, "two"), (4, alone), (5, ""), (None, ""), (6, "plain text")]
    assert got == Counter((i, t, len(t)) for i, t in texts)
    assert hx.extract_pages(d.limit(0)).count() == 0


def test_differencing_decides_beside_the_article(spark):
    page = "<body><div class='wrap'><p>{0}</p></div><h1>Head {1}</h1><article><p>Sign up for our letter</p><h2>Story {1}</h2><p>{1} words that make up this story, which no other page of the host has in its text</p><p>{2}</p><p>Read it all in print</p></article><p>{0} too</p></body>"
    rows = [(i, f"http://h.com/n/{i}", page.format("Open until nine", x, "The same sentence by chance" if i in (2, 3) else f"own {x}")) for i, x in enumerate("abcde")]
    rows += [(10, "http://one.org/", page.format("Open until nine", "z", "w")), (11, "http://two.org/a", "<article><p>part one</p></article><p>between</p><article class='story-body'><p>part two, longer</p></article>")]
    rows += [(12, "http://three.org/a", "<article><h1>T</h1><div class='related-work'>Related work section</div><p class='share-price'>up</p><p class='banner-year ad-hoc'>x</p><div class='reader-comments'>nice</div><div id='cookieBanner'>c</div></article>")]
    rows += [(13, "http://copy.org/1", "<article><p>all of it</p><p>is copied</p></article>"), (14, "http://copy.org/2", "<article><p>all of it</p><p>is copied</p></article>"), (15, "http://copy.org/3", "<article><p>all of it</p><p>is copied</p></article>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text.split("\n\n") for r in hx.extract_pages(d).collect()}
    for i in (1, 2, 3):  # neighbours on both sides: what all share at the article's ends goes, a chance sentence within stays
        x = "abcde"[i]
        assert got[i] == [f"Head {x}", f"Story {x}", f"{x} words that make up this story, which no other page of the host has in its text", "The same sentence by chance" if i in (2, 3) else f"own {x}"]
    assert got[0][0] == "Head a" and got[0][1] == "Sign up for our letter" and "Open until nine" not in got[0]
    assert got[10] == ["Sign up for our letter", "Story z", "z words that make up this story, which no other page of the host has in its text", "w", "Read it all in print"]
    assert got[11] == ["part one", "part two, longer"]
    assert got[12] == ["T", "Related work section", "up", "x"]
    assert got[13] == got[14] == got[15] == ["all of it", "is copied"]


def test_blocks_of_pages_change_nothing(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        body = "".join(f"<p>{rng.choice(['menu', 'shop', 'news', 'about', f'own {i} {k}'])}</p>" for k in range(8))
        rows.append((i, f"http://{'hot' if i % 3 else f'h{i % 7}'}.com/{i % 11}/{i}", body))
    rows += [(900 + i, *rows[4][1:]) for i in range(200)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    n = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for parts in ("1", "3", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append(rows_of(hx.extract_pages(d.repartition(5)), "page_id", "text"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert got[0] == got[1] == got[2] and sum(got[0].values()) == len(rows)
    # The same by hand: pages in order of their address, equal pages as one.
    order = sorted({(u.split("/")[2], "/" + u.split("/", 3)[3], h) for _, u, h in rows}, key=lambda p: p[:2])
    text = {}
    for k, (host, path, page) in enumerate(order):
        near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order) and order[j][0] == host]
        alike = [len(os.path.commonprefix([path, p[1]])) for p in near]
        lines, shared = re.findall("<p>(.*?)</p>", page), set()
        for p, a in zip(near, alike, strict=True):
            if a == max(alike):
                shared |= hx.common_lines(*([zlib.crc32(x.encode()) for x in re.findall("<p>(.*?)</p>", h)] for h in (page, p[2])))
        text[(host, path)] = "\n\n".join([x for j, x in enumerate(lines) if j not in shared] or lines)
    assert got[0] == Counter((i, text[(u.split("/")[2], "/" + u.split("/", 3)[3])]) for i, u, _ in rows)


def test_long_pages_are_aligned_in_little_memory():
    rng = random.Random(5)
    a, b = ([rng.randrange(3000) for _ in range(6000)] for _ in range(2))
    tracemalloc.start()
    n = len(hx.common_lines(a, b))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 100 and peak < 16 << 20


def test_common_lines_are_a_longest_subsequence():
    rng = random.Random(4)

    def length(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            best = _row(best, x, b)
        return best[-1]

    def _row(above, x, b):
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        return row

    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        assert len(hx.common_lines(a, b)) == length(a, b)


def test_media_round_trip(docs, texts):
    want = Counter()
    for i, t in texts:
        raw = (t or "").encode()
        pay = raw + b" " * (-len(raw) % 192 if raw else 192)
        want[(i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))] += 1
    assert rows_of(mk.media_features(docs), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    m = mk.parse_media(mk.write_media(b"z" * 192 * 700))
    assert len(m.packets) == 700 and m.clusters == len(m.cues) == 3 and [p[1] for p in m.packets] == [4 * k for k in range(700)]
    assert mk.packet_table(mk.store_texts(docs)).count() == sum(k[2] // 192 * n for k, n in want.items())


def test_media_file_and_feature_by_an_own_reader(spark):
    """The stored file, element by element, and the feature from its samples alone."""

    def number(data, at, keep):
        n = 8 - data[at].bit_length() + 1
        v = int.from_bytes(data[at : at + n], "big")
        return (v if keep else v & ~(1 << 7 * n)), at + n

    def leaves(data, at, end, path=()):
        while at < end:
            ident, at = number(data, at, True)
            size, at = number(data, at, False)
            if ident in (0x18538067, 0x1F43B675, 0x1C53BB6B, 0xBB, 0xB7, 0x1654AE6B, 0xAE, 0xE1, 0x1549A966, 0x1A45DFA3, 0xA0):
                yield from leaves(data, at, at + size, (*path, ident))
            else:
                yield (*path, ident), data[at : at + size]
            at += size
        assert at == end

    text = "Some samples, " * 200
    row = mk.media_features(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    raw = text.encode()
    payload = raw + b" " * (-len(raw) % 192)
    media = bytes(mk.store_texts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().media)
    assert row.media_bytes == len(media) and row.media_sha256 == hashlib.sha256(media).hexdigest()
    blocks = [v for path, v in leaves(media, 0, len(media)) if path[-1] in (0xA3, 0xA1)]
    samples = b""
    for b in blocks:
        _, at = number(b, 0, False)
        lacing = b[at + 2] >> 1 & 3
        assert lacing in (0, 2)
        samples += b[at + 3 + (lacing > 0) :]
    assert samples == payload
    v = np.frombuffer(payload, np.uint8).astype(int)
    above = v > v.mean()
    said = dict(x.split("=") for x in row.feature.split(";"))
    assert said["mean"] == f"{v.mean():.4f}" and abs(float(said["var"]) - v.var()) < 1e-3 and int(said["crossings"]) == (above[1:] != above[:-1]).sum()
    assert int(said["packets"]) == len(payload) // 192 and int(said["clusters"]) == sum(1 for path, _ in leaves(media, 0, len(media)) if path[-1] == 0xE7) == int(said["cues"])


@pytest.mark.parametrize("kind", [1, 3])
def test_other_lacings_are_read(kind):
    sizes = [300, 20, 255, 40]
    if kind == 1:
        head = b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    else:
        head = mk.write_size(300, 2) + b"".join(mk.write_size(b - a + 8191, 2) for a, b in zip(sizes, sizes[1:-1], strict=False))
    data = bytes([3]) + head + b"x" * sum(sizes)
    assert mk.lace_sizes(data, 0, len(data), kind) == (sizes, 1 + len(head))


def test_token_counts_equal_the_library(spark, docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tc.TOKENIZER)
    lib = Tokenizer.from_file(path)
    want = Counter((i, len((t or "").encode()), n, n > 2048) for i, t in texts for n in [len(lib.encode(t or "", add_special_tokens=False).ids)])
    assert rows_of(tc.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    parts = ["'", "''", "'r", "'re", "x", "it's", "'ll", "Σ", "ΑΣ ", "İ", "½", "Ⅷ", "\x1c", "\x85", "é", "é", "日本", "👩‍👧", "<|endoftext|>", "<|EndOfText|>", " ", "\n", "!!!", "_", "don't", "12", "ß", "word" * 9]
    rng, counter, small = random.Random(2), tc.TokenCounter(path), tc.TokenCounter(path, chunk=5)
    for _ in range(1500):
        t = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert counter.count(t) == small.count(t) == len(lib.encode(t, add_special_tokens=False).ids), t


def test_long_texts_without_white_space_take_memory_of_their_size():
    import public_tokenizers

    counter = tc.TokenCounter(public_tokenizers.path(tc.TOKENIZER))
    for unit, tokens in (("ab", 1 << 20), ("日本", None), ("!?", None)):
        text = unit * (1 << 20)
        counter.count(unit * 70)  # states are compiled
        tracemalloc.start()
        n = counter.count(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 6 * len(text.encode()) + (1 << 20) and n > len(text) // 4
        if tokens:
            assert n == tokens


def test_maps_of_chunks_compose_in_any_order():
    import public_tokenizers

    counter, rng = tc.TokenCounter(public_tokenizers.path(tc.TOKENIZER)), random.Random(8)
    for _ in range(200):
        text = "".join(rng.choices(["word", "'", "'s", "'re", " ", "12", "!!", "日本", "é", "x" * 9], k=40))
        split = tc.Splitter(counter, text)
        edges = split.edges(6)
        maps = [split.map_of(s, e) for s, e in zip(edges, edges[1:], strict=False)]
        while len(maps) > 1:
            k = rng.randrange(len(maps) - 1)
            maps[k : k + 2] = [split.then(*maps[k : k + 2])]
        assert maps[0].count + counter.word.finish(maps[0].behind[1]) == counter._pieces(text)


def test_contamination(spark):
    rng = random.Random(6)
    vocab = ["aa", "b1", "ç", "d", "e"] + [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 9, 10, 14, 30])))) for k in range(25)] + [(100, None), (101, "Aa, B1-ç"), (102, "Aa, B1-ç")]
    rows = []
    for k in range(80):
        w = rng.choices(vocab, k=60)
        it = (items[rng.randrange(25)][1] or "").split()
        at = rng.randrange(50)
        rows.append((k, ", ".join(w[:at]).upper() + "\n" + " . ".join(it[: rng.choice([5, 12, 40])]) + " " + "--".join(w[at:])))
    rows += [(900, None), (901, ""), (None, "aa b1 ç"), (3, "x")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for k, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows[tuple(w[s : s + n])].add(str(k))
    want = Counter()
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        want[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(dc.find_contamination(d, b), *cols) == want
    assert rows_of(dc.find_contamination(d, b, block_words=40), *cols) == want
    clean = dc.decontaminate(d, b.filter("item_id < 25"))
    assert clean.columns == d.columns
    assert dc.find_contamination(d, b.limit(0)).filter("contaminated").count() == 0


def test_cut_words_leaves_the_rest():
    assert dc.cut_words("One, two three. four", [(1, 3)]) == "One, \n. four"


def test_language_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    # A fifth of the rows declare nothing: their language is found from the text and their source.
    held = d.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("lang")))
    got = li._of_documents(held).select("doc_id", "__lang", "__accepted").join(d.select("doc_id", F.col("lang").alias("truth")), "doc_id").filter("doc_id % 5 = 0")
    r = got.agg(F.avg((F.col("__lang") == F.col("truth")).cast("int")).alias("right"), F.avg(F.col("__accepted").cast("int")).alias("kept")).first()
    assert r.right > 0.97 and r.kept > 0.97


def test_language_against_plain_bayes(spark, tmp_path):
    """All of the fusion by plain sums: models of the other half, declarations, suffix and host priors."""
    rng = random.Random(9)
    words = {"de": "der die das und nicht ist ein zu mit sich".split(), "en": "the and of to in is that it was for".split(), "l07": "lo zu ka mi ta ro ne si po ba".split()}
    rows = []
    for i in range(160):
        lang = rng.choice(["de", "en", "en", "l07"])
        text = " ".join(rng.choices(words[lang] + words["en"][:3], k=rng.choice([1, 2, 12])))
        said = rng.choice([lang, lang, lang, None, "de", lang.upper() + "-XX", ""])
        rows.append((i, f"http://{rng.choice('abc')}.{rng.choice(['de', 'com'])}/{i}" if i % 9 else None, text, said))
    rows += [(900, "http://a.de/", "", "de"), (901, None, "123", None), (902, "http://new.org/", "und nicht", None)]
    page = lambda t, said: f"<html{f' lang={said}' if said is not None else ''}><p>{t}</p>"
    d = spark.createDataFrame([(i, u, page(t, s)) for i, u, t, s in rows], "page_id long, url string, html string")
    got = {r.page_id: r for r in li._of_pages(d).collect()}

    halves = {r.page_id: r.half for r in d.select("page_id", li._half(F.concat(F.lit("  "), F.regexp_replace("html", "<[^>]*>", "").substr(1, 1000), F.lit(""))).alias("half")).collect()}
    plain = {i: r["__plain"] for i, r in got.items()}
    halves = {r.i: r.half for r in spark.createDataFrame([(i, t) for i, t in plain.items()], "i long, t string").select("i", li._half(F.col("t")).alias("half")).collect()}
    code = lambda s: (re.match("[A-Za-z]+", s)[0] if s and re.match("[A-Za-z]+", s) else "").lower() or None
    said = {i: code(s) for i, _, _, s in rows}
    said = {i: (s if s else None) for i, s in said.items()}
    langs = sorted({s for s in said.values() if s})
    grams = lambda t: Counter(((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 17 for a, b, c in zip(t.encode().lower(), t.encode().lower()[1:], t.encode().lower()[2:], strict=False))
    counts = {(half, lang): Counter() for half in (0, 1) for lang in langs}
    for t, lang in {(plain[i], said[i]) for i in plain if said[i]}:
        half = next(halves[i] for i in plain if plain[i] == t)
        counts[half, lang].update(grams(t))
    text_ll, best = {}, {}
    for i, t in plain.items():
        ll = []
        for lang in langs:
            own = counts[1 - halves[i], lang] or counts[halves[i], lang]
            total = sum(own.values()) + 0.5 * li.BUCKETS
            ll.append(sum(n * np.log((own[g] + 0.5) / total) for g, n in grams(t).items()))
        has = bool(re.search(r"[^\W\d_]", t)) and len(t) >= 3
        text_ll[i] = [li.TEMPER * (x - max(ll)) for x in ll] if has else [0.0] * len(langs)
        best[i] = text_ll[i].index(max(text_ll[i])) if has else None
    place = lambda u: (re.match("http://([^/]*)", u)[1], re.match(r"http://[^/]*\.([^./]*)", u)[1]) if u else (None, None)
    where = {i: place(u) for i, u, _, _ in rows}
    tally = lambda keep: np.array([sum(best[i] == k and keep(i) for i in plain) for k in range(len(langs))], float)
    total = tally(lambda i: True)
    overall = (total + 1) / (total.sum() + len(langs))
    given = {s: tally(lambda i, s=s: said[i] == s) for s in langs}
    every = sum(v.sum() for v in given.values())
    for i in plain:
        score = np.array(text_ll[i])
        if said[i] and given[said[i]].sum():
            v = given[said[i]]
            score = score + np.log((v + li.DECLARED_WEIGHT * v.sum() / every) / (sum(given.values()) + li.DECLARED_WEIGHT))
        host, suffix = where[i]
        of = tally(lambda j: where[j][1] == suffix)
        sp = (of + li.SUFFIX_WEIGHT * overall) / (of.sum() + li.SUFFIX_WEIGHT) if suffix else overall
        of = tally(lambda j: where[j] == (host, suffix))
        prior = (of + li.HOST_WEIGHT * sp) / (of.sum() + li.HOST_WEIGHT) if host else sp
        if not any(best[j] is not None for j in plain if where[j] == (host, suffix)):
            prior = overall
        score = score + np.log(prior)
        post = 1 / np.exp(score - score.max()).sum()
        assert got[i]["__lang"] == langs[int(score.argmax())] and abs(got[i]["__confidence"] - post) < 1e-4, (i, rows[i % len(rows)])
        assert got[i]["__accepted"] == (best[i] is not None and got[i]["__confidence"] >= li.ACCEPT)


def test_each_evidence_changes_results(spark):
    d = spark.read.parquet(f"{SF}/pages.parquet")
    bare = {r.page_id: r for r in li.identify(d.withColumn("t", F.lit("  ")), F.col("t"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")).collect()}
    assert all(not r["__accepted"] for r in bare.values())
    rows = [(i, "xyzzy", None, "a.de", "de") for i in range(3)] + [(100 + i, f"{w} Satz {i}", "de", f"h{i}.de", "de") for i, w in enumerate(["der und die"] * 40)] + [(200 + i, f"{w} row {i}", "en", f"h{i}.com", "com") for i, w in enumerate(["the and of"] * 40)]
    t = spark.createDataFrame(rows, "id long, text string, lang string, host string, suffix string")
    c, none = F.col, F.lit(None).cast("string")
    lang = lambda host, suffix: {r["__lang"] for r in li.identify(t, c("text"), c("lang"), host, suffix).filter("id < 3").collect()}
    confident = lambda host, suffix: li.identify(t, c("text"), c("lang"), host, suffix).filter("id = 0").first()["__confidence"]
    assert lang(c("host"), c("suffix")) == {"de"} and confident(none, c("suffix")) > confident(none, none)


def test_language_of_odd_rows(docs, spark):
    kept = li.keep_identified(docs)
    assert kept.columns == docs.columns
    assert not {r.doc_id for r in kept.filter("text is null or trim(text) = ''").collect()}
    assert li.keep_identified(docs.withColumn("lang", F.lit(None).cast("string"))).count() == 0
    p = li.identify_pages(spark.read.parquet(f"{SF}/pages.parquet"))
    assert p.columns == ["page_id", "url", "lang", "confidence", "accepted"] and p.filter("accepted").count() > 40


def test_mix(spark, docs, texts):
    got = mx.mix_sources(docs, slices=8).toPandas()
    assert len(got) == len(texts)
    size = {id_: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for id_, t in texts if id_ != 7}
    assert all(size[int(r.doc_id)] == r.size for r in got.itertuples() if r.doc_id == r.doc_id and r.doc_id != 7)
    by = got.assign(source=got.source.fillna("~")).groupby("source").agg(n=("size", "sum"), t=("target", "first"), k=("taken", "sum"), s=("source_size", "first"))
    names = sorted(by.index)  # "~" stands for null and sorts last here
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * by.n.sum()
    while True:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * by.n[s]]
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 2.0 * by.n[s] for s in over}
        free -= set(over)
        left = 1.5 * by.n.sum() - sum(target.values())
    for s in names:
        assert by.n[s] == by.s[s] and abs(by.t[s] - target[s]) < 1e-6 and abs(by.k[s] - by.t[s]) <= 1
    assert (got.taken <= 2 * got["size"]).all()
    again = mx.mix_sources(docs.repartition(2), slices=8).toPandas()
    key = lambda d: Counter(zip(d.doc_id.fillna(-1), d["size"], d.taken, strict=True))
    assert key(again) == key(got)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(t):
    o = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    o += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    o += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(o, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_secrets(docs, texts):
    scanner, rng = ss.SecretScanner(), random.Random(1)
    parts = ["token", "secret", "Password", "api_key", "=", ":", " ", "'", '"', "abc", "AKIA", "ABCD1234", "deadbeef", "0123", "é", "\n", "x"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        assert [x for x in scanner.scan(t) if x[0] in ("assign", "access", "hex")] == secrets(t), t
    want = Counter()
    for i, t in texts:
        o = secrets(t or "")
        n = Counter(k for k, _, _ in o)
        want[(i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in o).encode()).hexdigest())] += 1
    assert rows_of(ss.find_secrets(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    clean = ss.redact_secrets(docs)
    assert clean.columns == docs.columns and ss.find_secrets(clean).filter("n_assign + n_access + n_hex > 0").count() == 0


def test_empty_tables(docs):
    none = docs.limit(0)
    import public_tokenizers

    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    count = lambda d: tc.count_tokens(d, public_tokenizers.path(tc.TOKENIZER))
    ops = (sd.drop_repeated_units, sx.remove_repeats, sh.find_near_duplicates, mk.media_features, mx.mix_sources, ss.find_secrets, li.keep_identified, count)
    for op in (*ops, lambda d: dc.find_contamination(d, items), lambda d: dc.decontaminate(d, items), ss.redact_secrets, sh.drop_near_duplicates, lambda d: mx.mix_sources(d, keep=True)):
        assert op(none).count() == 0


def test_spread_hosts_get_the_same_answers(spark, monkeypatch):
    rows = [(i, f"the words of row {i} and more of them" if i % 3 else f"die Worte der Zeile {i} und mehr", "en" if i % 3 else "de", "hot" if i % 2 else None if i % 5 else f"s{i}") for i in range(60)]
    rows += [(90, None, None, "hot"), (91, "", "en", None), (91, "", "en", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"rows": F.lit(1), "m": F.create_map(F.lit("a"), F.lit(1))})
    want = None
    for spread in (1, 7, 1_000):
        monkeypatch.setattr(li, "SPREAD", spread)
        got = Counter(tuple(r) for r in li._of_documents(d).select("doc_id", "__lang", "__confidence", "__accepted").collect())
        assert sum(got.values()) == len(rows) and got == (want or got)
        want = got


def test_rare_languages_and_copies_in_the_models(spark):
    rows = [(f"the words of row {i} and more of them", "en") for i in range(400)] + [("die Worte der Zeile", "de"), ("les mots de la ligne", "fr")]
    many = spark.createDataFrame(rows, "t string, l string")
    langs, _ = li.fit_models(many, F.col("t"), F.col("l"), sample_rows=10)
    assert langs == ["de", "en", "fr"]
    # Copies change no model, nor do they keep another text out.
    few = spark.createDataFrame(rows[-40:], "t string, l string")
    copies = spark.createDataFrame(rows[-40:] + [rows[-3]] * 500 + [rows[-1]] * 500, "t string, l string")
    assert (li.fit_models(few, F.col("t"), F.col("l"), 50)[1] == li.fit_models(copies, F.col("t"), F.col("l"), 50)[1]).all()


def test_registered_query_identifies_pages_by_suffix(spark, tmp_path):
    page = "<html{}><body><p>{}</p></body></html>"
    rows = [(i, f"http://a{i}.de/", page.format(' lang="de"', f"die Worte der Zeile {i} und noch mehr davon")) for i in range(30)]
    rows += [(100 + i, f"http://b{i}.fr/", page.format(' lang="fr"', f"les mots de la ligne {i} et encore plus")) for i in range(30)]
    rows += [(200, "http://n.de/", page.format("", "xyz")), (201, "http://n.fr/", page.format("", "xyz"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = li.op8_language_id(spark, str(tmp_path)).collect()
    lang = {r.page_id: r.lang for r in got if r.page_id is not None}
    assert len(lang) == 62 and lang[200] == "de" and lang[201] == "fr"
    assert Counter(r.doc_id for r in got if r.page_id is None) == Counter(r.doc_id for r in docs.collect())
