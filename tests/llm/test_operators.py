"""The training-data operators beside brute force on small tables, and their defined cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalloom.llm import catalog, langid, merkle, minhash, packing, pii, quality, secret_scan, sentencepieces, sharding, suffixes

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_no string, slice_no string, kept string, n_bytes string, quality string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    body = " ".join(f"w{i % 97} v{i % 89}" for i in range(400))
    texts = [None, "", " \n\t ", "one", "Two words", body, body, body + " tail", "long " * 60_000, "é\n\n日本 \U0001f600", "a@b.co token = \"Zx9+kQ77pLm2\""]
    rows = [(i, t, "en" if i % 2 else None, "s", None, "r", None, "k", "b", "q") for i, t in enumerate(texts)]
    rows += [rows[5], (None, body, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


OPERATORS = {
    "shard": lambda d: sharding.shard(d),
    "pieces": lambda d: sentencepieces.decode(sentencepieces.encode(d)),
    "secrets": lambda d: secret_scan.scan(d),
    "suffixes": lambda d: suffixes.remove_repeats(d),
    "merkle": lambda d: merkle.fingerprints(d),
    "next": lambda d: merkle.with_next(d, "doc_id", "text", []),
    "quality": lambda d: quality.measure(d),
    "pii": lambda d: pii.scan(d),
    "packing": lambda d: packing.pack(packing.pieces(d)),
    "langid": lambda d: langid.identify(d, langid.fit(d)),
    "minhash": lambda d: minhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    out = OPERATORS[name](odd).toPandas()
    assert len(out) >= odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffixes_beside_brute_force(spark):
    texts = {i: (t or "").encode() for i, t in plain(spark).items()}
    times = Counter(b[k : k + 200] for b in texts.values() for k in range(len(b) - 199))
    for r in suffixes.query(spark, DATA).collect():
        b = texts[r.doc_id]
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if times[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), (b"\0" + gone).count(b"\0\1"), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("length", [3, 20, 50])
def test_suffixes_at_other_depths(spark, length):
    rng = np.random.default_rng(length)
    texts = ["".join(rng.choice(list("ab"), rng.integers(0, 120))) for _ in range(30)]
    times = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=length, slice_bytes=200)
    for r in out.collect():
        gone = {k + j for k in range(len(r.text) - length + 1) if times[r.text[k : k + length]] > 1 for j in range(length)}
        assert bytes(r.kept).decode() == "".join(c for k, c in enumerate(r.text) if k not in gone)


@pytest.mark.parametrize("period", suffixes.COVERS)
def test_covers(period):
    assert len({(a - b) % period for a in suffixes.COVERS[period] for b in suffixes.COVERS[period]}) == period


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def test_minhash_beside_brute_force(spark):
    sets = {i: shingles(t, 2) for i, t in plain(spark).items()}
    where, parent = defaultdict(list), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        both = Counter(j for g in sets[i] for j in where[g])
        for j, n in both.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for g in sets[i]:
            where[g].append(i)
    for r in minhash.query(spark, DATA).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_minhash_defined_cases(odd):
    out = minhash.near_duplicates(odd, words=2).select("doc_id", "n_shingles", "component_id", "chosen").collect()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[1].component_id == 1
    assert by[6].component_id == by[7].component_id == 5 and by[3].n_shingles == 1
    assert sum(r.chosen for r in out if r.component_id == 5) == 1


def test_packing(spark):
    from tokenizers import Tokenizer

    from evalloom.llm.common import vocabulary_path

    tokenizer = Tokenizer.from_file(vocabulary_path(packing.VOCABULARY))
    out = packing.query(spark, DATA).toPandas().sort_values(["sequence_id", "offset"])
    size = out.groupby("sequence_id").length
    assert size.sum().max() <= 2048 and (out.offset == size.cumsum() - out.length).all()
    assert out.sequence_id.nunique() >= packing.lower_bound(out.length.to_numpy(), 2048)
    found = {(r.doc_id, r.piece): r for r in out.itertuples()}
    for i, t in plain(spark).items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p, s in enumerate(range(0, len(ids), 2048)):
            own, r = ids[s : s + 2048], found.pop((i, p))
            assert (r.start, r.length, r.ids_crc32) == (s, len(own), zlib.crc32(own.tobytes()))
    assert not found


def test_lower_bound_holds():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 101, 200)
        assert packing.lower_bound(lengths, 100) <= packing.best_fit_decreasing(lengths, 100)[2]
    assert packing.lower_bound(np.full(10, 51), 100) == 10


def test_word_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    from evalloom.llm.common import vocabulary_path
    from evalloom.llm.word_tokens import WordTokens, json_tokenizer, text_ids

    path = vocabulary_path(packing.VOCABULARY)
    texts = ["Don't STOP, now... it's 42nd", "<|endoftext|> x<|startoftext|>y", "é É ß ẞ Σας İi ﬁ", "a b c 日本語。", "Wörter, ÀÉ!? x", ""]
    ids, at = text_ids(pa.array(texts), WordTokens(json_tokenizer(path)))
    whole = Tokenizer.from_file(path)
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_sharding(spark):
    out = sharding.query(spark, DATA).toPandas()
    assert sorted(out.doc_id) == sorted(plain(spark)) and out.shard.between(0, 39).all()
    slots = out.groupby("shard").slot.agg(["min", "max", "count", "nunique"])
    assert (slots["min"] == 0).all() and (slots["max"] + 1 == slots["count"]).all() and (slots["nunique"] == slots["count"]).all()


def test_merkle(spark):
    docs = sorted(plain(spark).items(), reverse=True)
    out = {r.doc_id: r for r in merkle.query(spark, DATA).collect()}
    for k, (i, t) in enumerate(docs):
        n, after = len(t), docs[(k + 1) % len(docs)][1]
        edited = t[: n - n // 2] + after[: n // 2]
        assert (out[i].n_chars, out[i].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= out[i].near_next <= 1 and 0 <= out[i].near_edited <= 1
    texts = defaultdict(set)
    for i, t in docs:
        texts[out[i].fingerprint].add(t)
    assert all(len(x) == 1 for x in texts.values())
    pair = spark.createDataFrame([("a b\nccc\n\nd", "a b\nccx\n\nd\ne")], "a string, b string")
    found = pair.select(merkle.differing(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("d")).first().d
    assert [tuple(x) for x in found] == [(0, 1), (1, 1)]


def test_quality(spark):
    out = {r.doc_id: r for r in quality.query(spark, DATA).collect()}
    for i, t in plain(spark).items():
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        times = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + j for k in range(len(w) - 4) if times[tuple(w[k : k + 5])] > 1 for j in range(5)}
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected


def test_quality_rejects_junk_without_repeats(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(5)
    kinds = {"base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "printable": "".join(map(chr, range(33, 127))), "letters": "abcdefghijklmnopqrstuvwxyz"}
    junk = [" ".join("".join(rng.choice(list(chars), 8)) for _ in range(n)) for chars in kinds.values() for n in (40, 120, 400)]
    planted = spark.createDataFrame([(-1 - i - 10 * k, t, lang) for i, t in enumerate(junk) for k, lang in enumerate(("en", "de", "fr", "es"))], "doc_id long, text string, lang string")
    out = quality.verdicts(docs.unionByName(planted)).withColumn("failed", quality.base_failed(F.col("quality")))
    out = out.join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label")), "doc_id", "left").toPandas()
    bad = out[out.doc_id < 0]
    short = -bad.doc_id % 10 % 3 == 1
    # of the junk of 40 words, random letters may look like French
    assert not bad.failed.any() and not bad[~short].kept.any() and bad[short].kept.sum() <= 1
    clean = out[(out.label == 1) & ~out.failed]
    assert set(clean.lang) == {"de", "en", "es", "fr"} and (clean.groupby("lang").kept.mean() >= 0.97).all()


def base_personal(t):
    luhn = lambda s: sum(d - 9 if d > 9 else d for d in (int(c) << (i & 1) for i, c in enumerate(reversed(s)))) % 10 == 0
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]


def test_personal_data(spark):
    texts = [*plain(spark).values(), "a@b@c.de x@y..z +1 (2) 1.2.3.4.5.6.7.8 1.2.3.999 4111 1111 1111 1111 5", "@.@a.b +12345678901 +1+22222222222"]
    for t in texts:
        found = [s for s in pii.find_personal(t) if s[0] in pii.BASE_KINDS]
        assert sorted(found) == sorted(base_personal(t)), t[:80]
    assert pii.redact_text("mail a@b.co!", pii.find_personal("mail a@b.co!")) == "mail <EMAIL>!"


def test_secrets(spark):
    assign = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for t in [*plain(spark).values(), "PassWord='abc' apikey: a1b2c3d4 AKIA" + "A" * 16 + " " + "0a" * 12]:
        base = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        assert sorted(s for s in secret_scan.find_secrets(t) if s[0] != "guess") == sorted(base)
    assert secret_scan.guess_bits("changeme")[0] < secret_scan.MIN_BITS < secret_scan.guess_bits("Zx9+kQ77pLm2")[0]


def least_bits(value):
    """The least bits over all segmentations, segment by segment."""
    s, low = secret_scan, value.lower()
    plain = low.translate(s.LEET)

    def segment(i, j):
        v, n, out = value[i:j], j - i, [sum(map(s.char_bits, value[i:j]))]
        if rank := s.RANK.get(plain[i:j]):
            capitals, letters = sum(map(str.isupper, v)), sum(map(str.isalpha, v))
            written = 0 if not capitals else 1 if capitals == letters or (capitals == 1 and v[0].isupper()) else capitals
            out.append(np.log2(rank + 1) + written + sum(a != b for a, b in zip(low[i:j], plain[i:j], strict=True)))
        if v in s.SEPARATORS or v in s.PAIRS:
            out.append(s.SEPARATOR_BITS)
        out += [sum(map(s.char_bits, v[:k])) + np.log2(n // k) for k in (1, 2, 3, 4) if n >= max(3, 2 * k) and n % k == 0 and v == v[:k] * (n // k)]
        if n >= 4 and all(s.adjacent(a, b) for a, b in zip(low[i:j], low[i + 1 : j], strict=False)):
            out.append(np.log2(47) + 1.5 * (n - 1))
        if s.DATE.fullmatch(v):
            out.append(s.DATE_BITS if n > 4 else s.YEAR_BITS)
        return min(out) + 2

    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + segment(i, j) for i in range(j)))
    return best[-1]


def test_guess_bits_beside_brute_force():
    rng = np.random.default_rng(3)
    parts = ["zxcvbn", "qwer", "master", "m", "xx", "abab", "1999", "20240131", "P@ssw0rd", "7", "aaa", "#", "key", "asdf", "12", "Key", "TOKEN", "mAster", "M4ster", "${", "}}", "()", "_", ".", "::"]
    values = ["".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(300)] + ["".join(rng.choice(list("ab1"), rng.integers(1, 30))) for _ in range(300)]
    for v in [*values, "zxcvbnmaster1", "x" * 60, "abc" * 20 + "d"]:
        bits, segments = secret_scan.guess_bits(v)
        assert abs(bits - least_bits(v)) < 1e-9, v
        assert [i for _, i, _ in segments] == [0, *(j for _, _, j in segments[:-1])] and segments[-1][2] == len(v)
    for v in ("x" * 96, "*" * 500, "x" * 200_000, "zxcvbnmaster1"):
        assert secret_scan.guess_bits(v)[0] < secret_scan.MIN_BITS


def test_planted_secrets_and_placeholders():
    from evalloom.llm.common import vocabulary_path

    rank = secret_scan.dictionary(vocabulary_path(secret_scan.VOCABULARY))
    flagged = lambda v: any(k == "guess" for k, _, _ in secret_scan.find_secrets(f"password = {v}", rank=rank))
    placeholders = ["${DATABASE_PASSWORD}", "<your-api-key-here>", "process.env.SECRET_TOKEN", "{{secrets.api_token}}", "REPLACE_WITH_YOUR_PASSWORD", "getConfig().getSecretToken()", "YOUR_API_KEY", "os.environ[TOKEN]", "settings.PASSWORD", "config.get(SECRET_KEY)", "self.api_key", "changeme123", "xxxxxxxxxxxx", "Password2024", "qwertyuiop"]
    assert [v for v in placeholders if flagged(v)] == []
    rng = np.random.default_rng(8)
    kinds = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_."]
    found = [flagged("".join(rng.choice(list(c), n))) for c in kinds for n in (12, 16, 24, 40) for _ in range(50)]
    assert sum(found) >= 0.99 * len(found)


def test_language_id(spark):
    out = langid.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_long_texts_teach_a_language(spark):
    rows = [(i, f"{w} " * 300 + str(i), lang) for i, (lang, w) in enumerate([("aa", "bako tami"), ("bb", "xyzzu qorv")] * 3)]
    docs = spark.createDataFrame([(i, t * (1 if lang == "aa" else 3), lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    out = langid.identify(docs, langid.fit(docs, sample_chars=4000)).select("lang", "langid.lang").toDF("lang", "found").collect()
    assert all(r.lang == r.found for r in out)


def test_sentencepiece(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    from evalloom.llm.common import vocabulary_path

    path = vocabulary_path(sentencepieces.VOCABULARY)
    pieces, tokens = sentencepieces.vocabulary(path)
    score = dict(zip(pieces.ids.tolist(), pieces.scores.tolist(), strict=True))
    model = proto.ModelProto()
    model.ParseFromString(open(path, "rb").read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        p.score = score.get(i, p.score)
    other = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [*list(plain(spark).values())[:80], "a  b   c", " x ", "日本語 😀\n\ty", "", "   "]
    ids, at = sentencepieces.encode_slice(pa.array(texts), tokens)
    assert pieces.decode_all(ids.astype(np.int64), at).to_pylist() == texts
    total = lambda x: sum(score.get(i, 0.0) for i in x)
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert abs(total(ids[a:b].tolist()) - total(other.encode(t))) < 0.01


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one = corpus_pipeline.language_id(spark, docs, DATA)
    two = corpus_pipeline.near_duplicates(spark, one, DATA)
    three = corpus_pipeline.repeated_passages(spark, two, DATA)
    four = corpus_pipeline.personal_data(spark, three, DATA)
    assert two.columns == three.columns == four.columns == docs.columns
    ids = {r.doc_id for r in four.select("doc_id").collect()}
    assert len(ids) == two.count() <= one.count() <= docs.count()
    assert not any(s for r in four.collect() for s in pii.find_personal(r.text) if s[0] in ("email", "phone"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == ids


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in catalog.queries()}


def test_unigram_vocabulary(spark, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    from evalloom.llm.common import vocabulary_path

    model = proto.ModelProto()
    model.ParseFromString(open(vocabulary_path(sentencepieces.VOCABULARY), "rb").read())
    model.trainer_spec.model_type = 1
    rng = np.random.default_rng(8)
    for p in model.pieces:
        if p.type == p.NORMAL:
            p.score = float(-2.5 - 9 * rng.random())
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = [*list(plain(spark).values())[:60], "a  b", "日本語 😀\n\ty", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = {i: p.score for i, p in enumerate(model.pieces) if p.type == p.NORMAL}
    total = lambda ids: sum(score.get(i, 0.0) for i in ids)
    # the library adds 32-bit numbers, so that segmentations of nearly one score may change places
    for r in sentencepieces.encode(docs, model=str(path)).collect():
        if r.text is None:
            assert r.piece_ids is None
            continue
        expected = library.encode(r.text)
        assert library.decode(r.piece_ids) == library.decode(expected) and abs(total(r.piece_ids) - total(expected)) < 1e-4 * max(1, len(expected))


def code_length(texts, text, order=langid.ORDER):
    """Bits of a text after the texts that were learned, byte by byte."""
    seen = defaultdict(Counter)
    for t in texts:
        b = langid.PAD + t.encode()
        for i in range(order, len(b)):
            for n in range(order + 1):
                seen[b[i - n : i]][b[i]] += 1

    def bits(context, byte):
        found = seen.get(context)
        shorter = lambda: bits(context[1:], byte) if context else 8.0
        if not found:
            return shorter()
        total, kinds = sum(found.values()), len(found)
        return -np.log2(found[byte] / (total + kinds)) if byte in found else -np.log2(kinds / (total + kinds)) + shorter()

    b = langid.PAD + text.encode()
    return sum(bits(b[i - order : i], b[i]) for i in range(order, len(b)))


def test_code_lengths_beside_brute_force():
    learned = {"aa": ["Ab cab, abba!", "A\nb", "A"], "bb": ["xyz Zyx\n\n\nxA", "été", ""], "cc": ["q" * 40]}
    model = langid.Model.from_counts({k: langid.count_contexts(v) for k, v in learned.items()})
    texts = ["A", "abba cab", "zyx xyz", "\n\nA b", "ünknown", "", "é", "qqqqq", "xA\nAb cab"]
    found = model.tables().bits([t.encode() for t in texts])
    for t, row in zip(texts, found, strict=True):
        assert np.allclose(row, [code_length(learned[k], t) for k in model.langs], atol=1e-3), t


def test_scripts():
    texts = {"שלום עולם": "hebrew", "საქართველო": "georgian", "Հայաստան": "armenian", "ภาษาไทย": "thai", "đường phố Việt": "latin", "ệểẫ": "latin", "नमस्ते": "indic", "かな仮": "kana", "漢字": "han", "한국어": "hangul", "ᏣᎳᎩ": "other", "12 + 3": "none", "": "none", "Ωa": "latin", "мир": "cyrillic"}
    raw = [t.encode() for t in texts]
    found = quality.scripts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert found == list(texts.values()) and set(quality.SCRIPTS) < set(quality.BANDS)


def test_words_of_a_vocabulary_are_cheap(spark):
    from evalloom.llm.common import vocabulary_path

    rank = secret_scan.dictionary(vocabulary_path(secret_scan.VOCABULARY))
    assert len(rank) > 10_000 and all(rank[w] == i for w, i in secret_scan.RANK.items())
    for value in ("internationalization", "welcome-to-paradise", "database-connection-string"):
        assert secret_scan.guess_bits(value, rank)[0] < secret_scan.guess_bits(value)[0]
    assert secret_scan.guess_bits("your_database_password_here", rank)[0] < secret_scan.MIN_BITS < secret_scan.guess_bits("Zx9_kQ7-pLm.2v", rank)[0]
    docs = spark.createDataFrame([(1, "token = your_database_password"), (2, "token: Zx9+kQ77pLm2"), (3, None), (4, "")], "doc_id long, secrets string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in secret_scan.scan(docs, "secrets", "found").collect()}
    assert found == {1: [("assign", 0, 30)], 2: [("assign", 0, 19), ("guess", 7, 19)], 3: [], 4: []}


def test_kd_tree_beside_brute_force(spark):
    rng = np.random.default_rng(6)
    n, shards = 150, 7
    a, b = rng.permutation(10_000)[:n], rng.permutation(500)[:n]
    sizes = rng.integers(5, 400, n)
    texts = [f"{i:05d}" + "x" * int(s) for i, s in enumerate(sizes)]
    # sources that share their first 12 characters, so that only whole values tell them apart
    docs = spark.createDataFrame([(i, t, f"https://host{int(y):03d}", int(x)) for i, (t, x, y) in enumerate(zip(texts, a, b, strict=True))], "doc_id long, text string, source string, n_chars long")
    found = {r.doc_id: r.shard for r in sharding.shard(docs, shards, dimensions=("source", "n_chars")).collect()}

    def places(v):
        lo, hi = min(v), max(v)
        return [1 + int((x - lo) / (hi - lo) * (2**31 - 2)) for x in v]

    keys = [places(np.argsort(np.argsort(b))), places(a)]
    weight = [len(t) + 16 for t in texts]
    expected = {}

    def split(items, first, count):
        if count == 1:
            expected.update(dict.fromkeys(items, first))
            return
        key = max(keys, key=lambda k: max(k[i] for i in items) - min(k[i] for i in items))
        items = sorted(items, key=lambda i: key[i])
        sums = np.cumsum([0, *(weight[i] for i in items)])
        cut = int(np.argmin(abs(sums - sums[-1] * (count // 2) / count)))
        split(items[:cut], first, count // 2)
        split(items[cut:], first + count // 2, count - count // 2)

    split(list(range(n)), 0, shards)
    assert found == expected


def test_sharding_contract(spark):
    texts = plain(spark)
    out = sharding.query(spark, DATA).toPandas()
    for r in out.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "bytes")
    folder = "/root/testdata/sf0.01"
    sums = sharding.query(spark, folder).groupBy("shard").agg(F.sum("size").alias("n")).toPandas().n
    assert len(sums) == 40 and sums.max() <= 1.5 * sums.mean()


def test_sharding_defined_cases(spark, odd):
    out = sharding.shard(odd, 3).toPandas()
    assert len(out) == odd.count() and set(out.shard) <= {0, 1, 2}
    assert (out[out.doc_id == 0]["size"] == 16).all() and (out[out.doc_id == 0].text_crc32 == 0).all()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    copies = spark.createDataFrame([(1, "same text")] * 400, "doc_id long, text string")
    assert sharding.shard(copies, 4).groupBy("shard").count().toPandas()["count"].between(50, 150).all()


def test_shards_are_written(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "shards"), shards=5)
    out = spark.read.parquet(str(tmp_path / "shards")).toPandas()
    placed = {r.doc_id: r.shard for r in sharding.shard(docs, 5).collect()}
    assert {r.doc_id: r.shard for r in out.itertuples()} == placed and {r.doc_id: r.text for r in out.itertuples()} == plain(spark)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_next_documents_beside_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_BYTES", 64)
    name = (lambda i: i) if kind == "long" else (lambda i: f"k{i:04d}")
    rows = [(name(i), f"text {i} " * 3) for i in range(150)] + [(name(70), f"copy {i}") for i in range(60)] + [(None, f"none {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(7)
    out = [(r.id, r.text, r.next.text) for r in merkle.with_next(docs, "doc_id", "text", []).collect()]
    assert sorted(out, key=str) == sorted({(i, t, n) for i, t, n in out}, key=str) and sorted((t for _, t, _ in out)) == sorted(t for _, t in rows)
    # each document has one next, and all of them make one ring that goes down by id
    after, of = {t: n for _, t, n in out}, {t: i for i, t in rows}
    first = "text 149 " * 3
    ring, at = [first], after[first]
    while at != first:
        ring.append(at)
        at = after[at]
    assert len(ring) == len(rows)
    ids = [of[t] for t in ring]
    known = [i for i in ids if i is not None]
    assert ids == [*known, *[None] * 40] and known == sorted(known, reverse=True)


def test_roots_and_likeness_beside_brute_force(spark):
    texts = {r.doc_id: (r.text, r.edited_sha256) for r in merkle.query(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), "doc_id").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    pieces = lambda t: {p[i : i + 32] for p in t.split("\n") for i in range(0, len(p), 32)}
    docs = sorted(((i, t) for i, (t, _) in texts.items()), reverse=True)
    out = {r.doc_id: r for r in merkle.query(spark, DATA).collect()}
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        root = lambda x: sha(";".join(sha(",".join(sha(p) for p in s.split("\n"))) for s in x.split("\n\n")))
        assert out[i].fingerprint.split(":")[0] == root(t) and out[i].edited_fingerprint.split(":")[0] == root(edited)
        dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
        assert abs(out[i].near_edited - dice(pieces(t), pieces(edited))) < 1e-12 and abs(out[i].near_next - dice(pieces(t), pieces(after))) < 1e-12


def test_inserted_paragraphs(spark):
    pair = spark.createDataFrame([("a\nb\n\nc\nd", "a\nnew\nb\n\nc\nd"), ("a\nb", "a\nb"), ("", "x")], "a string, b string")
    assert [r.n for r in pair.select(merkle.edited_paragraphs(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("n")).collect()] == [1, 0, 1]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    expected = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, DATA).select(*expected.columns)
    assert sorted(map(tuple, got.collect())) == sorted(expected.fetchall())


def test_names_that_share_a_fingerprint():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 300):
        names = rng.integers(0, 9, n).astype(np.uint64), rng.integers(0, 5, n).astype(np.uint32)
        pairs = sorted(zip(*(x.tolist() for x in names), strict=True))
        assert list(zip(*(x.tolist() for x in suffixes.ordered(names)), strict=True)) == pairs
        assert suffixes.unwire(suffixes.wire(suffixes.ordered(names)))[1].tolist() == [c for _, c in pairs]
        twice = [p for i, p in enumerate(pairs) if pairs[max(0, i - 2) : i] != [p, p]]
        assert list(zip(*(x.tolist() for x in suffixes.at_most_twice(names)), strict=True)) == twice
        once = suffixes.distinct(suffixes.ordered(suffixes.taken(names, slice(0, n, 2))))
        half = set(zip(*(x[::2].tolist() for x in names), strict=True))
        assert len(once[0]) == len(half)
        assert suffixes.among(names, once).tolist() == [p in half for p in zip(*(x.tolist() for x in names), strict=True)]
