"""The pipeline against plain versions of its stages."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
from tritlake.llm import language_id as li
from tritlake.llm import simhash as sh

from .test_operators import secrets

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def hit_words(t, windows):
    w, hit = words(t), set()
    for s in range(len(w) - 9):
        if tuple(w[s : s + 10]) in windows:
            hit.update(range(s, s + 10))
    return w, hit


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "mix_sources"]
    got = cp.run(spark, SF)
    assert got.columns == [*docs.columns, "size", "target", "taken", "epochs"]
    out = {r.doc_id: r for r in got.collect()}
    text = {r.doc_id: r for r in docs.collect()}

    kept = {r.doc_id for r in li.keep_identified(docs).collect()}
    assert len(kept) > 0.95 * len(text)
    # Near-duplicates, all pairs: the smallest id of each component stays.
    ids = sorted(kept)
    fp = [sh.fingerprint(text[i].text) & (1 << 64) - 1 for i in ids]
    label = list(range(len(ids)))
    while True:
        new = [min(label[b] for b, y in enumerate(fp) if (x ^ y).bit_count() <= 4) for x in fp]
        if new == label:
            break
        label = new
    kept = {i for k, i in enumerate(ids) if label[k] == k}
    # Benchmark passages, every window.
    windows = {tuple(w[s : s + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [words(r.text)] for s in range(len(w) - 9)}
    left, cut = set(), set()
    for i in kept:
        w, hit = hit_words(text[i].text, windows)
        runs = re.findall("1+", "".join("1" if k in hit else "0" for k in range(len(w))))
        if hit and (max(map(len, runs)) >= 13 or len(hit) >= 0.2 * len(w)):
            continue
        left.add(i)
        if hit:
            cut.add(i)
    # Secrets of the base kinds are gone; documents without a finding are as they were.
    sizes = defaultdict(int)
    for i in left:
        if i in out:
            assert not secrets(out[i].text) and not hit_words(out[i].text, windows)[1]
            if i not in cut and "[REDACTED]" not in out[i].text:
                assert out[i].text == text[i].text
            sizes[out[i].source] += out[i].taken
            assert out[i].size == len(re.findall(r"[^\x20\x09-\x0D]+", out[i].text)) and out[i].n_chars == len(out[i].text)
            assert 0 < out[i].taken <= 2 * out[i].size
    assert set(out) <= left
    for s, n in sizes.items():
        assert abs(n - next(r.target for r in out.values() if r.source == s)) <= 1


ODD = "doc_id long, text string, lang string, source string, n_chars long, size string, taken string, target double, text_lang string, fp string"


def odd_rows():
    prose = ["the words of row {} and more of them, which stand here to be long enough", "die Worte der Zeile {} und noch mehr davon, damit sie lang genug ist"]
    rows = [(i, prose[i % 2].format(" ".join(f"w{i}x{k}" for k in range(30))), ["en", "de"][i % 2], f"s{i % 3}", 1, "a", "b", 1.0, "c", "d") for i in range(40)]
    rows += [rows[3]] * 4 + [(None, *rows[5][1:])] * 2 + [(50, None, "en", "s0", 7, "a", "b", None, "c", "d"), (51, "", "en", None, 0, "a", "b", 1.0, "c", "d"), (52, "12 34", None, "s1", 5, None, None, None, None, None)]
    rows += [(60, "the long one " * 20000, "en", "s2", 1, "a", "b", 1.0, "c", "d"), (61, "a row of words with a secret: password=abcdefgh99 in the text of it", "en", "s1", 1, "a", "b", 1.0, "c", "d")]
    return rows


def test_each_stage_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, "some benchmark words that stand in no document at all here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    rows = Counter(tuple(r) for r in docs.collect())
    by_stage = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        by_stage[name] = Counter(tuple(r) for r in out.collect())
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = by_stage["language_id"]
    assert not kept - rows and {r[0] for r in rows - kept} >= {50, 51, 52} and sum(kept.values()) > 35
    assert kept[odd_rows()[3]] == 5  # repeated rows are kept alike
    kept = by_stage["simhash_near_dedup"]
    assert not kept - rows and sum(n for r, n in kept.items() if r[0] is None) == 2 and kept[odd_rows()[3]] == 5 and sum(r[0] in (50, 51) for r in kept) == 1
    same = lambda counted: Counter({(r[:4], r[5:]): n for r, n in counted.items()})  # noqa: E731  n_chars follows the text
    assert same(by_stage["benchmark_decontamination"]) == same(rows)
    changed = same(rows) - same(by_stage["secret_scan"])
    assert {r[0][0] for r in changed} == {61} and all("abcdefgh99" not in (r[1] or "") for r in by_stage["secret_scan"])


def test_mix_of_repeated_rows_and_clashing_names(spark, tmp_path):
    rows = [r for r in odd_rows()] * 3
    docs = spark.createDataFrame(rows, ODD).repartition(5)
    out = cp.mix(spark, docs, str(tmp_path))
    assert out.columns == [*docs.columns, "mix_size", "mix_target", "mix_taken", "epochs"]
    assert cp.mix(spark, docs.limit(0), str(tmp_path)).count() == 0
    got = out.collect()
    assert not Counter(tuple(r)[:10] for r in got) - Counter(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    for r in got:
        taken[r.source] += r.mix_taken
        target[r.source] = r.mix_target
        assert 0 < r.mix_taken <= 2 * r.mix_size and r["size"] in ("a", None) and abs(r.epochs - r.mix_taken / r.mix_size) < 1e-9
    assert set(taken) == {"s0", "s1", "s2"} and all(abs(taken[s] - target[s]) <= 1 and target[s] <= 2 * size[s] for s in taken)


def test_run_on_odd_tables(spark, tmp_path):
    spark.createDataFrame(odd_rows(), ODD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = cp.run(spark, str(tmp_path)).collect()
    assert len(out) > 20 and not {r.doc_id for r in out} & {50, 51, 52}
    spark.createDataFrame([], ODD).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
