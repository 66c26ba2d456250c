"""Language ID, decontamination, WARC fixity, URL rules and the pipeline: brute force, planted cases and edges."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

import corpus_pipeline
from sigspark.llm import chat_format, decontaminate, language_id, media, near_dup, queries, storage, token_frames, url_filter, warc_fixity

# Language identification


def best_path(score, switch):
    """Viterbi in its plainest form: the total of the best labelling of all words."""
    value = score[0].astype(float)
    for row in score[1:]:
        value = np.array([max(value[j] - (switch if j != i else 0) for j in range(len(row))) + row[i] for i in range(len(row))])
    return value.max()


def test_viterbi_reaches_the_best_total():
    rng = np.random.default_rng(0)
    for _ in range(200):
        score = rng.normal(0, 4, (rng.integers(1, 30), 4)).astype(np.float32)
        model = language_id.Model(list("abcd"), np.zeros((4, 4), np.float32), np.ones((1, 4), bool), 6.0)
        path = model.path(score)
        total = sum(float(score[i, p]) for i, p in enumerate(path)) - 6.0 * int((np.diff(path) != 0).sum())
        assert total == pytest.approx(best_path(score, 6.0), abs=1e-3)


def test_language_query_on_held_out_documents(spark, sf_dir):
    langs = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op5_language_id(spark, sf_dir).collect()
    assert len(rows) == len(langs) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    judged = [r["lang_pred"] == langs[r["doc_id"]][0] for r in rows if r["held_out"] and langs[r["doc_id"]][0] and r["lang_pred"] != "und"]
    assert sum(judged) >= 0.9 * len(judged) > 0
    assert {r["lang_pred"] for r in rows} <= {x for x, _ in langs.values()} | {"und"}
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in langs[r["doc_id"]][1] or "")) for r in rows)


def test_languages_spans_scripts_and_edges(spark):
    words = {"en": "the house and where they should think", "de": "nicht schon zwischen müssen sprechen durch", "el": "καλημέρα λόγος άνθρωπος θάλασσα"}
    rng = random.Random(1)
    rows = [(i * 3 + k, " ".join(rng.choice(text.split()) for _ in range(60)), lang) for i in range(20) for k, (lang, text) in enumerate(words.items())]
    df = spark.createDataFrame([*rows, (None, "x", "en"), (999, None, "de"), (998, "y", None)], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert [s[0] for s in model.spans(" ".join([words["en"]] * 3 + [words["de"]] * 3 + [words["el"]] * 3))] == ["en", "de", "el"]
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "12 !?", "c"), (4, words["el"] * 2000, "d"), (4, words["el"], "d")], "doc_id long, text string, score string")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language_id.predict(odd, model).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "el"), (4, "el")]
    assert language_id.predict(odd.limit(0), model).collect() == []
    nothing = language_id.fit(df.limit(0))
    assert nothing.predict("abc") == ("und", 0.0)


def test_scripts_narrow_the_candidates():
    languages = ["de", "el", "en"]
    scores = np.zeros((language_id.BUCKETS, 3), np.float32)
    scores[:, 1] = 50  # Greek would win everywhere
    written = np.ones((len(language_id.NAMES), 3), bool)
    written[language_id.NAMES.index("Latin")] = [True, False, True]
    written[language_id.NAMES.index("Greek")] = [False, True, False]
    model = language_id.Model(languages, scores, written)
    assert model.word_scores("only latin here")[1].tolist() == [0, 2]
    assert model.predict("only latin here")[0] == "de" and model.predict("λόγος")[0] == "el"
    assert [x for x, *_ in model.spans("some words λόγος more words")] == ["de", "el", "de"]


def test_language_query_is_the_plain_viterbi(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(held.where(~language_id.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op5_language_id(spark, sf_dir).collect()}
    for doc_id, text in docs:
        score, among, n = model.word_scores(text)
        if not len(n):
            assert got[doc_id] == ("und", 0.0)
            continue
        path = model.path(score)
        total = sum(float(score[i, p]) for i, p in enumerate(path)) - model.switch * int((np.diff(path) != 0).sum())
        assert total == pytest.approx(best_path(score, model.switch), rel=1e-4, abs=1e-2)
        share = np.bincount(path, weights=n, minlength=len(among))
        assert got[doc_id] == (model.languages[among[share.argmax()]], pytest.approx(share.max() / share.sum()))


# Decontamination


def edit_distance_in(item, text):
    """Least edits between ``item`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_q_gram_lemma_loses_nothing():
    rng = random.Random(4)
    letters = "abcdefghij "
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(30, 160)))) for i in range(12)]
    index = decontaminate.Index(items)
    for _ in range(150):
        i, item = rng.choice(items)
        hurt = list(item)
        for _ in range(rng.randrange(0, 12)):
            k = rng.randrange(len(hurt))
            hurt[k : k + 1] = rng.choice([[], [rng.choice(letters)], [hurt[k], rng.choice(letters)]])
        text = "".join(rng.choice(letters) for _ in range(60)) + "".join(hurt) + "".join(rng.choice(letters) for _ in range(60))
        data = decontaminate.normalise(text).tobytes()
        expected = {}
        for j, t in items:
            m = decontaminate.normalise(t).tobytes()
            if (d := edit_distance_in(m, data)) <= decontaminate.budget(len(m)):
                expected[j] = d
        assert {j: e for j, e, *_ in index.leaks(text)} == expected


def banded_cost(item, data, low, high):
    """Least edits of ``item`` and a part of ``data`` on diagonals ``low`` to ``high``, cell by cell."""
    far = 10**6
    cost = {(0, d): 0 for d in range(low, high + 1) if 0 <= d <= len(data)}
    for i in range(1, len(item) + 1):
        for d in range(low, high + 1):
            j = i + d
            if 0 <= j <= len(data):
                change = cost.get((i - 1, d), far) + (1 if j == 0 or item[i - 1] != data[j - 1] else 0)
                cost[i, d] = min(change if j else far, cost.get((i - 1, d + 1), far) + 1, cost.get((i, d - 1), far) + 1)
    return min([far, *(c for (i, _), c in cost.items() if i == len(item))])


def test_banded_alignment_is_that_of_single_cells():
    rng = np.random.default_rng(3)
    for _ in range(300):
        item, data = rng.integers(0, 3, rng.integers(1, 14)).astype(np.uint8), rng.integers(0, 3, rng.integers(0, 20)).astype(np.uint8)
        low = int(rng.integers(-8, 12))
        high = low + int(rng.integers(0, 9))
        found = decontaminate.align_banded(item, data, low, high)
        expected = banded_cost(item.tolist(), data.tolist(), low, high)
        assert (found[0] if found else 10**6) == expected
        if found:  # the part that it names has that distance
            assert edit_distance_in(item.tolist(), data[found[1] : found[2]].tolist()) <= found[0] and 0 <= found[1] <= found[2] <= len(data)


def best_edits(item, text):
    """Least edits of ``item`` in any part of ``text``: the whole matrix, a row at a time."""
    item, text = np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8)
    place = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(item.tolist(), 1):
        new = np.minimum(np.append(i, row[:-1] + (text != c)), row + 1)
        row = np.minimum.accumulate(new - place) + place
    return int(row.min())


def test_decontamination_query_is_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20_000)  # several blocks and passes
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", 2)
    docs = [(r["doc_id"], decontaminate.normalise(r["text"]).tobytes()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], decontaminate.normalise(r["text"]).tobytes()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    # Of an item cut in edits + 1 pieces one stands unhurt in any text that leaks it, so other pairs need no matrix.
    expected = {}
    for i, item in items:
        most = decontaminate.budget(len(item))
        cut = [item[len(item) * k // (most + 1) : len(item) * (k + 1) // (most + 1)] for k in range(most + 1)]
        for d, text in docs:
            if any(p in text for p in cut) and (edits := best_edits(item, text)) <= most:
                expected[d, i] = edits
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in queries.op2_decontamination(spark, sf_dir).collect()}
    assert got == expected and len(got) > 0


def test_decontamination_edges(spark):
    item = "Which of these answers is the right one for the question?"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "tiny")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, item.upper()), (3, item.upper()), (4, "x " * 50_000 + item), (5, "a tiny bit"), (6, "destiny"), (None, item), (8, "clean text about nothing in particular at all")]
    docs = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, edits string")
    got = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.find_leaks(docs, bench).collect()), key=str)
    assert got == sorted([(3, 1, 0), (3, 1, 0), (4, 1, 0), (5, 4, 0), (None, 1, 0)], key=str)
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()) == [1, 2, 6, 8]
    assert decontaminate.find_leaks(docs.limit(0), bench).collect() == [] == decontaminate.find_leaks(docs, bench.limit(0)).collect()
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == len(rows)


# WARC fixity


def test_audit_query_finds_each_decayed_record(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    expected = sorted(r["page_id"] for r in pages.where("page_id % 97 = 5").collect())
    assert sorted(r["page_id"] for r in queries.op8_warc_fixity(spark, sf_dir).collect()) == expected


def test_audit_rows_equal_hashes_of_the_files(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(4)
    pages = pages.unionByName(pages.where("page_id < 3"))  # repeated pages
    index, primary = warc_fixity.archive(pages)
    mirror = warc_fixity.copy_with_faults(index, storage.new_dir(spark, "mirror"), F.col("page_id") % 11 == 2)
    levels = [warc_fixity.merkle_levels(warc_fixity.hash_records(index, x), name) for x, name in ((primary, "one"), (mirror, "two"))]
    got = sorted(tuple(r) for r in warc_fixity.audit(*levels).collect())
    theirs = {r["shard"]: r["path"] for r in mirror.collect()}
    expected = []
    for r in index.collect():
        hashes = []
        for path in (r["path"], theirs[r["shard"]]):
            with open(path.removeprefix("file://"), "rb") as file:
                file.seek(r["offset"])
                content = hashlib.sha256(file.read(r["length"])).hexdigest()
            hashes.append(hashlib.sha256(f"{r['offset']},{r['offset'] + r['length']},{content}".encode()).hexdigest())
        if hashes[0] != hashes[1]:
            expected.append((r["page_id"], r["shard"], r["seq"], r["offset"], r["length"], *hashes))
    assert got == sorted(expected) and {r[0] for r in got} == {r["page_id"] for r in pages.where("page_id % 11 = 2").collect()}
    plan = warc_fixity.audit(*levels)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_fixity_of_missing_shards_and_record_round_trip(spark):
    html = "<p>né</p>" * 50
    fields, body = warc_fixity.parse_record(warc_fixity.record(3, "http://a/\r\nb", html))
    assert body == html.encode() and fields["WARC-Target-URI"] == "http://a/%0D%0Ab"
    rows = [(i, f"http://h/{i}", None if i % 7 == 0 else f"<p>{i}</p>") for i in range(300)] + [(None, None, None), (5, "http://h/5", "<p>5</p>")]
    pages = spark.createDataFrame([(*r, "o") for r in rows], "page_id long, url string, html string, offset string").repartition(3)
    index, primary = warc_fixity.archive(pages)
    assert index.count() == 302
    ours = warc_fixity.merkle_levels(warc_fixity.hash_records(index, primary), "a")
    lost = index.agg({"shard": "min"}).first()[0]
    half = warc_fixity.merkle_levels(warc_fixity.hash_records(index, primary.where(f"shard <> {lost}")), "b")
    found = warc_fixity.audit(ours, half).collect()
    assert len(found) == index.where(f"shard = {lost}").count() + 1 and {r["theirs"] for r in found} == {"missing"}
    assert warc_fixity.audit(ours, ours).collect() == []
    copy = warc_fixity.copy_with_faults(index, storage.new_dir(spark, "mirror"), F.lit(None).cast("boolean"))
    path = copy.where(f"shard = {lost}").first()["path"].removeprefix("file://")
    with open(path, "ab") as file:
        file.write(b"more")
    grown = warc_fixity.merkle_levels(warc_fixity.hash_records(index, copy), "d")
    at = index.where(f"shard = {lost}").agg(F.max(F.col("offset") + F.col("length"))).first()[0]
    assert [(r["page_id"], r["shard"], r["offset"], r["length"]) for r in warc_fixity.audit(ours, grown).collect()] == [(None, lost, at, 0)]
    nothing, none = warc_fixity.archive(pages.limit(0))
    empty = warc_fixity.merkle_levels(warc_fixity.hash_records(nothing, none), "c")
    assert warc_fixity.audit(empty, empty).collect() == []


# URL rules


def brute_rule(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, a) for h, p, a in rules if f".{host}".endswith(f".{h}") and path.startswith(p)]
    _, rule, action = max(fits, default=(0, None, "allow"))
    return host, path, rule, action


def test_url_rules_nest_and_hot_hosts_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MIN_SLICE_ROWS", 16)
    rng = random.Random(6)
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/", "block"), ("b.a.example.net", "/x", "allow"), ("com", "/q", "block"), ("le.net", "/", "allow")]
    rules += [("com", "", "allow"), ("com", "/q/a", "allow"), ("com", "/q/a/b", "block"), ("com", "/q/ab", "block"), ("a\x01net", "/", "block"), ("a", "/x", "block"), ("com", "/\U0010ffff", "block")]
    hosts = ["example.net", "a\x01net", "a", "b.a\x01net", "a\x02net", "x.com", "com", "www.example.net", "a.example.net", "c.b.a.example.net", "xle.net", "le.net", "net", "Q.COM", "org", "", "example.net.", "exam-ple.net"]
    urls = [f"{rng.choice(['http', 'x', ''])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/x', '/xy', '/q?z=/', '#/en/', '?a/b', '/q/a', '/q/a/bc', '/q/a/c', '/q/abc', '/\U0010ffff\U0010ffffz', '/q/'])}" for _ in range(900)] + [None, "", "no scheme", "http://", "a://b://c/d", "http://net/\n/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://net/", "h"), (0, urls[0], "h")], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, action string")
    got = url_filter.match_urls(pages, table).collect()
    assert len(got) == len(urls) + 2
    assert {r["page_id"]: tuple(r)[1:] for r in got if r["page_id"] is not None} == {i: brute_rule(u, rules) for i, u in enumerate(urls)}
    assert {r["verdict"] for r in url_filter.match_urls(pages, table.limit(0)).collect()} == {"allow"}
    assert url_filter.match_urls(pages.limit(0), table).collect() == []


def test_url_plan_has_no_python(spark, sf_dir):
    plan = queries.op9_url_filter(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# The pipeline


def test_pipeline_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(3, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item, passage, base = prose(30), prose(60), prose(150)
    texts = {i: prose(120) for i in range(1, 30)} | {30: base, 31: base, 32: base.replace(base.split()[70], "changed", 1), 40: prose(40) + " " + passage, 41: prose(50) + " " + passage, 50: prose(30) + " " + item, 60: "12 34", 61: None, 62: ""}
    rows = [(i, t, "en" if i % 4 else None, "web", len(t or "")) for i, t in texts.items()]
    sf_dir = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    docs = storage.table(spark, sf_dir, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = storage.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(texts) - set(kept[0]) == {60, 61, 62}
    assert set(kept[0]) - set(kept[1]) == {31, 32}
    assert set(kept[2]) == set(kept[1]) and passage in kept[2][40] and passage[10:-10] not in kept[2][41]
    assert all(kept[2][i] == texts[i] for i in range(1, 30))
    assert set(kept[2]) - set(kept[3]) == {50}
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == set(kept[3])
    (folder,) = {r["tokens"] for r in packed}
    stored = {r["doc_id"]: r["n_tokens"] for r in token_frames.read_token_frames(spark.read.parquet(f"{folder}/manifest")).collect()}
    assert stored == {i: sum(r["length"] for r in packed if r["doc_id"] == i) for i in kept[3]}


def test_pipeline_stages_keep_columns_of_any_names(spark, tmp_path):
    sf_dir = f"file://{tmp_path}"
    extra = ["n_removed", "kept", "n_bytes", "tile", "a.b", "found_lang", "cut_kept", "rep", "grp", "dest", "shingles", "component_id", "item_id", "c0", "x`y", "Found_Share"]
    texts = [(1, "the house and where they should think of it all day long"), (1, "the house and where they should think of it all day long"), (2, None), (3, ""), (None, "nothing else like this one, a text of no id"), (4, "une maison " * 9000), (5, "the house and where they should think of it all day long again")]
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), *(StructField(c, StringType()) for c in extra)])
    docs = spark.createDataFrame([(i, t, "en", None, None, *extra) for i, t in texts], schema)
    spark.createDataFrame([(1, "no such text in any of the documents here")], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = (storage.materialize(stage(spark, x, sf_dir), name) for x in (docs, empty))
        assert docs.schema.names == empty.schema.names == schema.names
        assert all([r[c] for c in extra] == extra for r in docs.collect()) and empty.count() == 0
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "1", "4", "None"]
    packed = corpus_pipeline.best_fit_packing(spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {1, 4, None}
    assert corpus_pipeline.best_fit_packing(spark, empty, sf_dir).count() == 0


def test_pipeline_drops_near_copies_of_similarity_80(spark):
    words = [f"w{i}" for i in range(104)]
    near, far = words.copy(), words.copy()  # 100 shingles, of which 10 or 15 differ: similarity 90/110 and 85/115
    near[20] = near[60] = "x"
    far[20] = far[50] = far[80] = "y"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, 3}
    assert all(r["kept"] for r in near_dup.near_duplicates(docs).collect())


def test_nothing_else_imports_this_subpackage():
    import pathlib

    root = pathlib.Path(chat_format.__file__).parent.parent
    assert not [p for p in root.rglob("*.py") if p.parent.name != "llm" and "sigspark.llm" in p.read_text()]
    assert media.UNIT == 192
