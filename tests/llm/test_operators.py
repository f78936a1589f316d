"""The other operators: round trips, brute force, held-out accuracy, and odd inputs."""

import gzip
import hashlib
import json
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from ratersight.llm import decontamination, fingerprints, language, linkage, packing, quality, scratch, secrets, token_files, tokens, web_archives

DOCS = "doc_id long, text string, name string, start int, spans int"
ODD = [None, "", " ", "a", "  ", "a  b", "a\n b", "a \nb", "a\tb c\r\n d", "don't  stop 'll I'll", "É café́ x", "ΟΔΟΣ ς b", "日本語 テスト 한국어", "<|endoftext|> a", "x " * 30_000, "!!! ?? ...", "　y z", "a\x1cb \x85 c"]
public_tokenizers = pytest.importorskip("public_tokenizers")


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "n", 1, 2) for i, t in enumerate(texts)], DOCS)


def secret_spans(text):
    """By another engine."""
    rules = [("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    found = sorted((m.start(), i, k, m.end()) for i, (k, p, g, n) in enumerate(rules) for m in p.finditer(text or "") if len(m[g]) >= n)
    return [f"{k}:{a}:{b}" for a, _, k, b in found]


def test_secrets(spark):
    texts = [*ODD, "é𝄞 token = 'abcdef1' PASSWORD:x secret=token:abcdefgh", "AKIA" + "A1" * 9 + " AKIAshort " + "0f" * 13, "ſecret=abcdefgh toKen: 0123456789abcdef01234567", "gh" + "p_" + "a" * 36]
    d = docs(spark, texts).union(docs(spark, texts[-4:], 100)).union(docs(spark, texts[-4:], 100))
    rows = secrets.digest(secrets.scan(d, scratch.fresh(spark, "ledger"))).collect()
    assert len(rows) == len(texts) + 8
    of = dict(enumerate(texts)) | dict(enumerate(texts[-4:], 100))
    for r in rows:
        want = secret_spans(of[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x.split(":")[0] in ("assign", "access", "hex")] == want
    assert any(r.spans.startswith("hub:") for r in rows)


def test_ledger_scans_only_unseen_blobs(spark):
    ledger = scratch.fresh(spark, "ledger")
    secrets.scan(docs(spark, ["token=abcdefgh", "clean"]), ledger).collect()
    later = secrets.scan(docs(spark, ["token=abcdefgh", "secret=abcdefgh", "clean"], 10), ledger).collect()
    assert spark.read.parquet(f"{ledger}/seen").count() == 3 and spark.read.parquet(f"{ledger}/findings").count() == 2
    assert [len(r.spans) for r in sorted(later, key=lambda r: r.doc_id)] == [1, 1, 0]
    # other rules have another name in the ledger, so seen blobs are searched again
    rules = (*secrets.RULES, secrets.Rule("word", "cle+an"))
    again = secrets.scan(docs(spark, ["clean"]), ledger, rules).collect()
    assert [x.kind for x in again[0].spans] == ["word"] and spark.read.parquet(f"{ledger}/seen").count() == 4
    assert secrets.version_of(rules) != secrets.version_of(rules[::-1]) != secrets.version_of(secrets.RULES)
    assert secrets.scan(docs(spark, []), ledger).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("specials", [False, True])
def test_ids_equal_the_library(name, specials):
    from tokenizers import Tokenizer

    e = tokens.encoder(public_tokenizers.path(name), specials)
    fresh = Tokenizer.from_file(public_tokenizers.path(name))
    if not specials:
        fresh.encode_special_tokens = True  # as the files' description has it
    rng = random.Random(4)
    mixed = ["".join(rng.choice("aB é'ſ1 \n\t.,!ß́ 日s") for _ in range(rng.randrange(60))) for _ in range(500)]
    forged = ["hello <|endoftext|> world", "<|endoftext|>", "a<|startoftext|>b  <|endoftext|>", "<| endoftext |>"]
    for t in [*filter(None, ODD), *forged, *mixed, *mixed]:
        assert e.encode(t) == np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)
    ids = np.frombuffer(e.encode("x <|endoftext|> y"), "<u4")
    assert (fresh.token_to_id("<|endoftext|>") in ids) == specials


def test_words_are_kept_once():
    path = public_tokenizers.path("word_bpe_49k.json")
    e, whole = tokens.Encoder(path, json.load(open(path))["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), tokens.encoder(path)._library
    for text in ("One\ntwo one\n\n  TWO", " it's one's, 'S\n\n\u0130x \u0131 two! two7 7two two's", "a  b\n...\n. .x\u00d7y \u00f7", "\n", "a \u0301b\tc  d\u00a0e\nf"):
        assert e.encode(text) == whole(text), repr(text)
    e.new.clear()
    e.encode("one\ntwo one  Two\ntwo.")
    assert set(e.new) == {"one", "two", "two.", "."}


def test_token_files(spark):
    path, folder = public_tokenizers.path("word_bpe_49k.json"), scratch.fresh(spark, "tokens")
    d = docs(spark, ODD).orderBy(F.rand(3))
    manifest = token_files.write_tokens(d, folder, path, 2)
    rows = sorted(token_files.read_tokens(spark, manifest, folder).collect())
    e, start = tokens.encoder(path), 0
    for r, t in zip(rows, ODD, strict=True):
        ids = e._library(t or "") + b"\2\0\0\0"
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    for bounds in ({"most_docs": 3}, {"most_bytes": 60}):  # several shards of a part, and the same rows
        again = scratch.fresh(spark, "tokens")
        shards = token_files.write_tokens(d, again, path, 2, **bounds)
        assert shards.count() > manifest.count() and (bounds == {"most_bytes": 60} or all(r.n_docs <= 3 for r in shards.collect()))
        assert sorted(token_files.read_tokens(spark, shards, again).collect()) == rows
        assert shards.agg(F.sum("n_docs"), F.sum("n_tokens")).first() == (len(ODD), start)
    clash = d.selectExpr("doc_id", "text", "1 as start", "2 as n_tokens", "3 as part").union(d.limit(0).selectExpr("doc_id", "text", "1", "2", "3"))
    odd = clash.union(spark.createDataFrame([(None, "no id", 1, 2, 3), (None, None, 1, 2, 3), (0, "same id", 1, 2, 3)], clash.schema))
    again = scratch.fresh(spark, "tokens")
    got = token_files.read_tokens(spark, token_files.write_tokens(odd, again, path, 2), again).collect()
    assert len(got) == len(ODD) + 3 and sorted(r.start for r in got if r.doc_id is None)[0] == 0 and sum(r.doc_id == 0 for r in got) == 2
    name = manifest.first()["name"]
    file = f"{folder}/{name}".removeprefix("file://")
    whole = zstandard.ZstdDecompressor().stream_reader(open(file, "rb"), read_across_frames=True).read()
    assert token_files.read_document(folder, name, 0).tobytes() == whole[: 4 * rows[0].n_tokens]
    raw = bytearray(open(file, "rb").read())
    raw[-12] ^= 1  # a checksum in the seek table

    class Held:
        size = len(raw)

        @staticmethod
        def read(at, n):
            return bytes(raw[at : at + n])

    shard = token_files.ShardReader(Held)
    with pytest.raises(ValueError, match="checksum"):
        [shard.ids(i) for i in range(len(shard))]
    assert token_files.read_tokens(spark, token_files.write_tokens(d.limit(0), scratch.fresh(spark, "tokens"), path, 2), folder).collect() == []


def test_best_fit_equals_one_piece_at_a_time():
    rng = random.Random(6)
    for _ in range(12):
        counts = {rng.randrange(1, 65): rng.randrange(1, 200) for _ in range(rng.randrange(1, 30))}
        plan = packing.best_fit(counts, 64)
        seats, used = {}, {}
        for n, c in counts.items():
            rows = plan[n]
            for rank in range(c):
                at = np.searchsorted(rows[:, 0], rank, "right") - 1
                s = int(rows[at, 1] + rank - rows[at, 0])
                seats.setdefault(s, []).append((int(rows[at, 2]), n))
        for s, own in seats.items():
            own.sort()
            assert [a for a, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1])
            used[s] = sum(n for _, n in own)
        rooms = []  # one piece at a time
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 64) - n)
        assert max(used.values()) <= 64 and len(used) == len(rooms)


@pytest.mark.parametrize("salts", [None, (2, 7)])
def test_packing(spark, monkeypatch, salts):
    if salts:  # more salts than the least number, and nothing is broadcast
        monkeypatch.setattr(packing, "SALTS", salts[0])
        monkeypatch.setattr(packing, "SALT_ROWS", salts[1])
        monkeypatch.setattr(linkage, "BROADCAST_ROWS", 1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*ODD, "word " * 2047, "word " * 2048, "many words " * 3000]
    clash = docs(spark, texts).union(docs(spark, texts[:3])).withColumns({"length": F.lit("x"), "piece": F.lit(1.5), "salt": F.lit(None)})
    rows = packing.pack(clash, path).toPandas()
    assert len(rows[rows.doc_id == 0]) == 2  # a repeated row has pieces of its own
    alone = packing.pack(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string"), path).collect()
    assert len(alone) == 2 and {r.doc_id for r in alone} == {None} and len({r.sequence_id for r in alone}) == 1
    for i, t in enumerate(texts[3:], 3):
        ids = tokens.encoder(path)._library(t or "") + b"\0\0\0\0"
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() * 4 == len(ids)
        assert (own.length.iloc[1:] == 2048).all() and all(zlib.crc32(ids[4 * s : 4 * (s + n)]) == c for s, n, c in zip(own.start, own.length, own.ids_crc32))
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.length.sum() <= 2048 and (own.offset.to_numpy() == own.length.cumsum().to_numpy() - own.length).all()
    assert packing.pack(docs(spark, []), path).collect() == []


def test_quality_learns_and_leaves_inputs_alone(spark):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(400):
        words = ["the", "of", "and", *("w" + chr(97 + rng.randrange(26)) * 3 for _ in range(40))]
        rng.shuffle(words)
        bad = i % 4 == 0
        texts.append(" ".join(w.upper() + "!!" if bad and rng.random() < 0.8 else w for w in words))
        labels.append((i, int(not bad), 0))
    d = docs(spark, [*texts, None, ""])
    rows = quality.score(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas().set_index("doc_id")
    held = [i for i, q, _ in labels if rows.held_out[i]]
    assert held and all(rows.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows.index)
    assert np.mean([rows.predicted[i] == labels[i][1] for i in held]) > 0.95
    assert rows.score[400] == rows.score[401] and rows.score.between(0, 1).all()
    good = quality.keep_good(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert good.columns == d.columns and {r.doc_id for r in good.collect()} == set(rows.index[rows.predicted == 1])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(d.limit(3), none).collect()} == {0.5}
    assert quality.score(docs(spark, []), none).collect() == []


def test_pairs_of_features_are_learned():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((quality.learn(x, y).score(x) > 0.5) == y).mean() > 0.9


def test_language_of_mixed_texts(spark):
    rng = random.Random(9)
    make = {"aa": lambda: "".join(rng.choice(["ka", "mo", "ti"]) for _ in range(3)), "bb": lambda: "".join(rng.choice(["üsch", "ell", "ong"]) for _ in range(2))}
    rows = [(i, " ".join(make[x]() for _ in range(30)), x) for i in range(200) for x in ["aa" if i % 3 else "bb"]]
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "kamoti " * 40_000, None), (903, "kamoti", "zz")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(d).collect()}
    assert np.mean([got[i].lang_pred == x for i, _, x in rows[:200] if got[i].held_out]) > 0.98
    assert (got[900].lang_pred, got[900].score, got[901].lang_pred) == ("und", 0.0, "und") and got[902].lang_pred == "aa"
    model = language.fit(d)
    s = language.Settings()
    w = language.analyse(["kamoti timoka motika üschell ongell\nüschong"], s)
    p = model.posteriors(w)
    assert [model.languages[k] for k in p.argmax(axis=1)] == ["aa", "aa", "aa", "bb", "bb", "bb"]
    assert language.identify(d.limit(0)).collect() == []


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(3)
    model = language.Model(["a", "b"], rng.normal(size=(2, 1 << 10)), rng.normal(size=(2, 2)))
    w = language.analyse(["xy z wv u\nq"], language.Settings(bits=10))
    e, p = model.emissions(w), model.posteriors(w)
    want, total = np.zeros((4, 2)), 0.0
    for path in np.ndindex(2, 2, 2, 2):
        v = np.exp(sum(e[i, k] for i, k in enumerate(path)) + sum(model.moves[a, b] for a, b in zip(path, path[1:])))
        total += v
        for i, k in enumerate(path):
            want[i, k] += v
    assert np.allclose(p[:4], want / total) and np.allclose(p[4], np.exp(e[4]) / np.exp(e[4]).sum())


def semi_global(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_contaminations_equal_brute_force(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7)))
    items = [" ".join(word() for _ in range(20)) for _ in range(12)] + [None, "", "tiny", "of two"]
    texts = []
    for i in range(60):
        item = list(items[i % 12])
        for _ in range(i // 12 * 2):
            k = rng.randrange(len(item))
            item[k : k + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        around = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(2)]
        texts.append(f"{around[0]} {''.join(item).upper() if i % 2 else ''.join(item)}, {around[1]}" if i % 5 else around[0])
    texts[3] += " Tiny!"
    texts[4] += " untiny tinyest of  two"
    d = docs(spark, [*texts, None, ""])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    s = decontamination.Settings()
    want = set()
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            item = decontamination.normal(item)
            own = decontamination.normal(t)
            edits = semi_global(item, own) if int(len(item) * s.percent / 100) else 0 if item and f" {item} " in f" {own} " else 99
            if edits <= int(len(item) * s.percent / 100):
                want.add((i, k, edits))
    assert {(3, 14, 0), (4, 15, 0)} <= want and (4, 14, 0) not in want
    for settings in (s, decontamination.Settings(block_bytes=300)):
        got = {(r.doc_id, r.item_id, r.edits) for r in decontamination.contaminations(d, bench, settings).collect()}
        assert got == want and len(want) > 20
        left = decontamination.decontaminate(d, bench, settings)
        assert left.columns == d.columns and {r.doc_id for r in left.collect()} == set(range(62)) - {i for i, *_ in want}
    short = spark.createDataFrame([(0, "twenty one letters ab"), (1, "nineteen letters ab")], "item_id long, text string")  # one edit, none
    own = docs(spark, ["so twenty one lettrs ab it is", "so nineteen lettrs ab it is", "so nineteen letters ab, yes"])
    assert sorted((r.doc_id, r.item_id, r.edits) for r in decontamination.contaminations(own, short).collect()) == [(0, 0, 1), (2, 1, 0)]
    assert decontamination.contaminations(d, bench.limit(0)).collect() == [] and decontamination.decontaminate(d, bench.limit(0)).count() == 62


def test_archives(spark):
    rows = [(i, f"http://x/{i}\r\nX: y", h, "c") for i, h in enumerate(["<p>one", "<p>two é", "<p>one", None, "", "<p>one", "x\r\n\r\ny" * 9])] + [(None, None, "<p>one", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, name string")
    for force64 in (False, True):
        folder = scratch.fresh(spark, "archives")
        packages = web_archives.write_archives(pages, folder, force64=force64)
        got = {r.page_id: r for r in web_archives.read_archives(spark, packages, folder).collect()}
        refers = {0: 5, 2: 5, 3: 4, None: 5}
        for i, _, h, _ in rows:
            payload = (h or "").encode()
            want = (len(payload), web_archives.digest(payload), "revisit" if i in refers else "response", refers.get(i))
            assert tuple(got[i])[1:] == want
        file = f"{folder}/{packages.first()['name']}".removeprefix("file://")
        with zipfile.ZipFile(file) as z:
            assert z.testzip() is None
            assert gzip.decompress(z.read("archive/data-00000.warc.gz")).startswith(b"WARC/1.1\r\n")
    few = web_archives.write_archives(pages, scratch.fresh(spark, "archives"), least_bytes=100)
    assert few.agg(F.sum("records")).first()[0] == len(rows)
    empty = web_archives.write_archives(pages.limit(0), scratch.fresh(spark, "archives"))
    assert web_archives.read_archives(spark, empty, "file:///tmp").collect() == []


def test_archives_of_others(spark, tmp_path):
    page = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nhello"
    head = "WARC/1.0\r\nwarc-type: {}\r\nWARC-Record-ID: <urn:uuid:1>\r\n{}Content-Length: {}\r\n\r\n"
    info = gzip.compress(head.format("warcinfo", "", 3).encode() + b"x: \r\n\r\n")
    plain = head.format("response", "", len(page)).encode() + page + b"\r\n\r\n"
    again = gzip.compress(head.format("revisit", "WARC-Payload-Digest: sha1:ABC\r\n", 19).encode() + b"HTTP/1.0 200 OK\r\n\r\n\r\n\r\n")
    data = info + gzip.compress(plain) + again
    hello = web_archives.digest(b"hello")
    line = 'com,x)/ 20200101000000 {"filename": "a.warc.gz", "offset": "%d", "length": "%d"}\n' % (len(info), len(data) - len(info) - len(again))
    packages = {
        "walked": ([("archive/a.warc.gz", data, zipfile.ZIP_STORED)], [(5, hello, "response"), (None, "ABC", "revisit")]),
        "indexed": ([("archive/a.warc.gz", data, zipfile.ZIP_STORED), ("indexes/i.cdxj", "!meta {}\n" + line, zipfile.ZIP_DEFLATED)], [(5, hello, "response")]),
        "plain": ([("archive/b.warc", plain, zipfile.ZIP_STORED), ("indexes/i.cdxj", '{"filename": "b.warc", "offset": 0, "length": %d}' % len(plain), 0)], [(5, hello, "response")]),
        "packed": ([("archive/a.warc.gz", data, zipfile.ZIP_DEFLATED)], None),
        "no index": ([("archive/b.warc", plain, zipfile.ZIP_STORED)], None),
        "cut": ([("archive/a.warc.gz", data[:-9], zipfile.ZIP_STORED)], None),
        "empty": ([], []),
    }
    for name, (members, want) in packages.items():
        with zipfile.ZipFile(tmp_path / f"{name}.wacz", "w") as z:
            for member, content, method in members:
                z.writestr(member, content, method)
        read = web_archives._read(f"file://{tmp_path}")
        names = pa.RecordBatch.from_pydict({"name": [f"{name}.wacz"]})
        if want is None:
            with pytest.raises(ValueError):
                list(read([names]))
        else:
            got = [r for b in read([names]) for r in b.to_pylist()]
            assert [(r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in got] == want
            assert all(r["page_id"] is None and r["refers_to"] is None for r in got)
    own = spark.createDataFrame([("walked.wacz",), ("indexed.wacz",)], "name string")
    assert web_archives.read_archives(spark, own, f"file://{tmp_path}").count() == 3


def test_keys_of_urls():
    assert web_archives.url_key("http://Www.Example.com:8080/A?b=C") == "com,example,www:8080)/a?b=c"
    assert [web_archives.url_key(u) for u in (None, "", "no url", "http://[x", "http://x:y/")] == ["-", "-", "nourl", "http://[x", "http://x:y/"]


def test_neighbours_and_similar_sets(spark):
    rng = random.Random(12)
    base = " ".join(rng.choice(["the", "of", "and", "w%d" % rng.randrange(500)]) for _ in range(300))
    texts = [base, base, base + " the last words", None, "", "x", "| a1 | b2 | " * 40, *(" ".join(rng.sample(base.split(), 120)) for _ in range(30)), "the tail é𝄞 " * 5000]
    rows = sorted(fingerprints.neighbours(docs(spark, texts)).collect(), key=lambda r: r.doc_id)
    plain = [t or "" for t in texts]
    sets = [set(map(int, s)) for s in fingerprints.signatures(plain)]
    jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    for i, (r, t) in enumerate(zip(rows, plain, strict=True)):
        after = plain[(i + 1) % len(plain)]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(t), hashlib.sha256(edited.encode()).hexdigest())
        for got, want in ((r.near_next, jaccard(sets[i], sets[(i + 1) % len(plain)])), (r.near_edited, jaccard(sets[i], set(map(int, next(fingerprints.signatures([edited]))))))):
            assert got == pytest.approx(want)
    assert rows[0].fingerprint == rows[1].fingerprint != rows[7].fingerprint
    assert fingerprints.neighbours(docs(spark, [])).collect() == []
    single = fingerprints.neighbours(docs(spark, ["the only one here"])).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
    many = [base, *(" ".join(w for w in base.split() if rng.random() > 0.01 * i) for i in range(25))]
    own = [set(map(int, s)) for s in fingerprints.signatures(many)]
    classes, pairs = fingerprints.similar(docs(spark, many), 0.7)
    reps = {r.class_id for r in classes.collect()}
    want = {(i, j) for i in reps for j in reps if i < j and jaccard(own[i], own[j]) >= 0.7}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want


def chains(text, s=fingerprints.Settings()):
    """Signatures as tuples of words, by loops over lists."""
    anchors = {w for line in fingerprints.ANCHORS for w in line.split()}
    words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).encode().split()
    names = [w.decode() for w in words]
    out, since = set(), 0
    for i, w in enumerate(names):
        since = 0 if w in anchors or i == 0 else since + 1
        after = [x for x in names[i + 1 :] if x not in anchors][: s.chain]
        if (w in anchors or since > s.gap) and len(after) == s.chain:
            out.add((w, *after))
    if not out and names:
        n = min(len(names), s.chain + 1)
        out = {(n, *names[i : i + n]) for i in range(len(names) - n + 1)}
    return out


def test_signatures_equal_loops_over_lists():
    rng = random.Random(15)
    texts = [" ".join(rng.choice(["the", "of", "Und", "là", *(f"w{k}" for k in range(12))]) + rng.choice(["", ",", "! "]) for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += ["", " ", "a1", "x y", "x y z w", "the", "the of and", " ".join(f"q{i}" for i in range(30))]
    got, want = [s.tolist() for s in fingerprints.signatures(texts)], [chains(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    names = {}
    for g, w, t in zip(got, want, texts):  # a signature stands for one chain, and a chain has one signature
        for key in w:
            names.setdefault(key, set(g)).intersection_update(g)
    assert all(names.values())
    assert fingerprints.likeness(np.array([1, 2, 3]), np.array([2, 3, 4])) == 0.5 and fingerprints.likeness(np.array([1]), np.arange(50)) == 0.02 and fingerprints.likeness(np.array([99]), np.arange(50)) == 0.0
    rng = np.random.default_rng(8)
    for n, m in ((3, 900), (900, 3), (40, 60), (1, 1), (5, 2000)):
        x, y = (np.unique(rng.integers(0, 3000, k)) for k in (n, m))
        both = len(set(x.tolist()) & set(y.tolist()))
        assert fingerprints.likeness(x, y) == fingerprints.likeness(y, x) == both / (len(x) + len(y) - both)


def test_long_words_have_other_hashes():
    from ratersight.llm import hashing

    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    h, *_ = hashing.words([a.encode(), b.encode()])
    assert len(a) == 4096 and h[0] != h[1]
