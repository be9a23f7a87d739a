"""Operators on texts against brute force, with nulls, ties, repeated rows, long texts and clashing columns."""

import collections
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from compare import assert_same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenloom.llm import digests, langid, line_spread, mixing, near_copies, queries, rule_ledger, secret_scan, simhash, toxicity
from lumenloom.operators.resolve import connected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, size long, fingerprint string, n_lines string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """(doc_id, text, source) rows with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 1, 2, 3, "clash", "clash") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(7)
    long = " ".join(rng.choice("ab cd ef gh ij kl mn".split()) for _ in range(6000))
    same = "shared line of many words here\nown words follow at once ok"
    rows = [(4, same, "s1"), (1, None, "s2"), (2, "", "s3"), (9, long, "s1"), (None, same, "s4"), (3, same, None), (3, same, "s2"), (3, "other text of this id \n\n#$ x", "s2"), (8, " \t\n ", "s5")]
    rows += [(20 + k, f"shared line of many words here\n{k} " + "tail " * k, f"s{k}") for k in range(8)]
    return frame(spark, rows)


# rule ledger


def brute_measures(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def test_ablations_of_the_whole_table(spark, sf_dir):
    assert_same(queries.rule_ablations(spark, sf_dir), queries.oracle_sql()["rule_ablations"], sf_dir)


def test_measures_and_policies(odd):
    got = rule_ledger.ledger(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == brute_measures(r.text), r.text
        assert r.failures & 1 == (r.n_words < 20)
    assert rule_ledger.ledger(odd.limit(0)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "\n", " ", "c d e f g h i j ", " ", "#", "😀"]), max_size=60).map("".join), max_size=8))
def test_measures_of_any_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in rule_ledger.measure(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == brute_measures(r.text)


def test_ablations_equal_direct_evaluation(odd):
    entries = rule_ledger.ledger(odd).cache()
    bits = [r.failures for r in entries.collect()]
    for r in rule_ledger.ablations(entries).collect():
        whole, bit = rule_ledger.mask(rule_ledger.POLICIES[r.policy]), rule_ledger.mask([r.rule])
        assert (r.documents, r.kept) == (len(bits), sum(b & whole == 0 for b in bits))
        assert r.failed_alone == sum(b & (whole & ~bit) == 0 for b in bits) - r.kept
        assert r.failed == sum(b & bit != 0 for b in bits) and r.ever_failed == (r.failed > 0)
    assert {r.documents for r in rule_ledger.ablations(entries.limit(0)).collect()} == {0}


# source mix


def brute_targets(sizes, cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        left = [s for s in order if s not in fixed]
        share = (total - sum(fixed.values())) / max(sum(weight[s] for s in left), 1)
        over = [s for s in left if share * weight[s] >= cap * sizes[s]]
        if not over:
            return fixed | {s: share * weight[s] for s in left}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix_takes_what_targets_say(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 9), "big") for i in range(900)]
    rows += [(1000 + i, "w " * rng.randint(1, 9), f"s{i % 4}") for i in range(60)] + [(None, "w w", None), (5000, None, None), (5001, "", "empty"), (7, "w", "big"), (7, "w", "big")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in got:
        assert r.size == len(WORD.findall(r.text or ""))
        sizes[r.source] += r.size
    want = brute_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= 9, source
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(frame(spark, rows[::-1])).collect()))
    assert mixing.mix(frame(spark, [])).count() == 0


def test_budgets_of_a_source_are_nested(spark):
    sized = spark.range(500).select(F.lit("s").alias("source"), F.lit(2).cast("long").alias("size"), mixing.place(F.col("id")).alias("hash"))
    budgets = spark.createDataFrame([("s", k, float(b)) for k, b in enumerate((0, 10, 11, 500, 1000))], "source string, level int, budget double")
    found = {r.level: r.threshold for r in mixing.thresholds(sized, budgets).collect()}
    hashes = [r.hash for r in sized.collect()]
    took = [2 * sum(h < found[k] for h in hashes) for k in range(5)]
    assert took == sorted(took) and [abs(a - b) <= 1 for a, b in zip(took, (0, 10, 11, 500, 1000), strict=True)] == [True] * 5


# line spread


def brute_spread(rows, threshold=5, min_words=4):
    strip = "".join(map(chr, [32, *range(9, 14)]))
    held = collections.defaultdict(set)
    keep = {}
    for i, text, site in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(WORD.findall(line)) >= min_words:
                form = line.strip(strip)
                if site is not None:
                    held[form].add(site)
                keep[form] = min(i, keep.get(form, i))
    out = []
    for i, text, site in rows:
        lines = text.split("\n") if text is not None else []
        stay = [x for x in lines if i is None or len(WORD.findall(x)) < min_words or len(held[x.strip(strip)]) < threshold or i == keep[x.strip(strip)]]
        out.append((i, "\n".join(stay) if text is not None else None, len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("near", [1.0, 2.0, 100.0])
def test_boilerplate_lines(spark, odd, near):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    line_spread_near, line_spread.NEAR = line_spread.NEAR, near
    try:
        got = line_spread.remove_boilerplate(odd)
        assert got.columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_removed"]
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=repr) == brute_spread(rows)
    finally:
        line_spread.NEAR = line_spread_near
    assert line_spread.remove_boilerplate(odd.limit(0)).count() == 0


# SimHash


def brute_fingerprint(text, shingle=3):
    import xxhash

    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(values):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    values = sorted(parent)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("hot", [1, 3, 512])
def test_links_lose_nothing(spark, hot):
    rng = random.Random(hot)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    values = {0, (1 << 64) - 1, *seeds}
    for s in seeds:  # chains and stars of one to three flips
        at = s
        for _ in range(12):
            for _ in range(rng.choice([1, 2, 2, 3])):
                at ^= 1 << rng.randrange(64)
            values.add(at)
            values.add(s ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    distinct = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.root for r in connected(simhash.links(distinct, hot)).collect()}
    want = brute_components(signed)
    assert {v: found.get(v, v) for v in signed} == want


def test_pivot_table_bounds_distances():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 200), dtype=np.uint64)
    gap = np.abs(simhash.distance_table(a) - simhash.distance_table(b)).max(axis=1)
    assert (gap <= np.bitwise_count(a ^ b)).all()


def test_pivot_table_discards_most_pairs_that_are_apart():
    rng = np.random.default_rng(2)
    one = rng.integers(0, 1 << 63, dtype=np.uint64)
    same = np.uint64(0xFFFFFFFF)  # as in one key: half of the bits agree
    fps = np.concatenate([[one], (rng.integers(0, 1 << 63, 2000, np.uint64) & ~same) | (one & same)])
    near, left = simhash.survivors(simhash.distance_table(fps), fps, 0, simhash.RADIUS)
    assert left < 20 and all((fps[j] ^ fps[0]).bit_count() <= 2 for j in near)


def test_group_keys_meet_within_two_bits():
    rng = random.Random(4)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
        keys = simhash.group_keys(simhash.distance_table(np.array([a, b], np.uint64)))
        assert (keys[0] == keys[1]).any()


def test_near_duplicates(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = simhash.near_duplicates(odd).collect()
    assert sorted(((r.doc_id, r.fingerprint) for r in got), key=repr) == sorted(((i, f"{brute_fingerprint(t):016x}") for i, t in rows), key=repr)
    root = brute_components([brute_fingerprint(t) for _, t in rows])
    least = {}
    for i, t in rows:
        if i is not None:
            k = root[brute_fingerprint(t)]
            least[k] = min(i, least.get(k, i))
    assert all(r.component_id == least[root[int(r.fingerprint, 16)]] for r in got)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    stay = simhash.one_of_each(odd)
    assert stay.columns == odd.columns
    assert sorted([r.doc_id for r in stay.collect()], key=repr) == sorted([None, *least.values()], key=repr)


def test_one_of_each_tells_texts_of_one_id_apart(spark):
    rng = random.Random(11)
    x, y, z = (" ".join(rng.choices("abcdefgh", k=40)) for _ in "xyz")
    rows = [(1, x, "s"), (5, x, "s"), (5, y, "s"), (6, y, "s"), (7, z, "s"), (7, z, "s"), (8, None, "s"), (8, "", "s"), (9, None, "s"), (None, x, "s")]
    for keep in (simhash.one_of_each, near_copies.one_of_each):
        got = keep(frame(spark, rows)).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, x), (5, y), (7, z), (8, ""), (None, x)], key=repr)


CLASHES = "s threshold whole low below bucket cross row by one root version component_id name n fp band site pos h1 h2 first gone_doc gone_at gone_parts mix_source mix_place ledger_held ledger_windows __rows __parts doc k hash key held lang_pred score".split()


@pytest.mark.parametrize("apply", [simhash.one_of_each, simhash.near_duplicates, near_copies.one_of_each, mixing.mix, line_spread.remove_boilerplate, rule_ledger.ledger, secret_scan.scan, digests.edit_digests, langid.identify])
def test_other_columns_do_not_matter(odd, apply):
    plain = odd.select("doc_id", "text", "source", "lang")
    other = plain.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
    want, got = apply(plain), apply(other)
    columns = [c for c in want.columns if want.schema[c].dataType.simpleString()[:3] not in ("map",)]
    assert sorted(map(repr, want.select(columns).collect())) == sorted(map(repr, got.select(columns).collect()))
    kept = [c for c in CLASHES if c in got.columns and c not in want.columns]
    if "source" in want.columns:
        assert set(kept) == {c for c in CLASHES if c not in want.columns}
        assert {r[c] for r in got.collect() for c in kept[:1]} <= {CLASHES.index(kept[0])}


# canonical digests


def brute_canonical(text):
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", nfkc(nfkc(text or "").casefold())).strip()


def weak(form):
    return F.substring(F.sha2(form.cast("binary"), 256), 1, 1)


@pytest.mark.parametrize("bucket_of", [digests.bucket, weak])
def test_edit_digests(spark, bucket_of):
    texts = ["Straße ﬁn", "STRASSE  fin\n", None, "", "abc", "é" * 9, "é" * 9, "ß" * 400 + " end", "abc", "same text here", "same text here", "x y", "X y"]
    df = frame(spark, [(3 * k if k else None, t, "s") for k, t in enumerate(texts)])
    got = {r.doc_id: r for r in digests.edit_digests(df, bucket_of).collect()}
    assert len(got) == len(texts)
    order = [None, *sorted(k for k in got if k is not None)]
    text = {(3 * k if k else None): t or "" for k, t in enumerate(texts)}
    name, forms = {}, {}
    for k, i in enumerate(order):
        after = order[(k + 1) % len(order)]
        q = len(text[i]) // 4
        edited = text[i][: len(text[i]) - q] + text[after][:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text[i]), hashlib.sha256(edited.encode()).hexdigest())
        for form, fp in ((brute_canonical(text[i]), r.fingerprint), (brute_canonical(edited), r.edited_fingerprint)):
            assert name.setdefault(form, fp) == fp and forms.setdefault(fp, form) == form
        assert r.near_edited == float(brute_canonical(text[i]) == brute_canonical(edited))
        assert r.near_next == float(brute_canonical(text[i]) == brute_canonical(text[after]))
    assert digests.edit_digests(df.limit(0), bucket_of).count() == 0


def test_repeated_ids_share_the_next_text(spark):
    df = frame(spark, [(1, "aaaaaaaa", "s"), (1, "aaaaaaaa", "s"), (2, "zzzz", "s"), (2, "yyyy", "s")])
    got = digests.edit_digests(df).collect()
    assert len(got) == 4 and {r.edited_sha256 for r in got if r.doc_id == 1} == {hashlib.sha256(b"aaaaaayy").hexdigest()}


@pytest.mark.parametrize("bucket_of", [digests.bucket, weak])
def test_exact_groups(spark, bucket_of):
    rows = [(9, "A  b", "s"), (2, "a b", "s"), (5, "other", "s"), (None, "a B", "s"), (7, None, "s"), (8, " ", "s")] + [(100 + k, f"t{k}", "s") for k in range(40)]
    got = {r.doc_id: r.group_id for r in digests.exact_groups(frame(spark, rows), bucket_of).collect()}
    assert got == {9: 2, 2: 2, None: 2, 5: 5, 7: 7, 8: 7} | {100 + k: 100 + k for k in range(40)}


# secrets


def test_base_spans_are_the_contracts(spark):
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
    texts = [
        "password=abc secret: 'hunter22' API_KEY = \"xy.z-12345\" token=token=token=abcdef", "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "AKIAAKIA" + "C" * 12,
        "deadbeef" * 3 + " 0123456789abcdef01234567x " + "a" * 23, "paſsword=abcdefg toKen=abcdefgh", "", "😀 passwd : qwertyuiop",
    ]
    for t in texts:
        want = [(m.start(), m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert sorted(secret_scan.base_spans(t)) == sorted(want)


@pytest.mark.parametrize(
    ("text", "literal"),
    [
        ('db_pwd = "s3cr3t!Value"', "s3cr3t!Value"),
        ('part = "Zx81-Qp77-Lk"\nclient.bearer = part', "Zx81-Qp77-Lk"),
        ('a = "Tr0ub4dor&3xy"\nb = a\nmy_credential := b', "Tr0ub4dor&3xy"),
        ('{"privateKey": "k9#Lm2$pQ7"}', "k9#Lm2$pQ7"),
        ("<passphrase>Horse-77-Staple</passphrase>", "Horse-77-Staple"),
        ("export DB_PWD='aa11-BB22-cc33'", "aa11-BB22-cc33"),
        ('auth_token: str = "x"\ntokens = "Q1w2-E3r4-T5y6"', "Q1w2-E3r4-T5y6"),
    ],
)
def test_lexer_follows_assignments(text, literal):
    assert literal in [text[a:b] for a, b, _, _ in secret_scan.lexed_spans(text)]


@pytest.mark.parametrize("text", ["the password is long", 'title = "A quiet Day-at 17"', "pwd = ${DB_PWD}", 'credential = "changeme"', "a = b\nb = a\nsecret = a", "time: 12:30, ratio = 0.5", ""])
def test_lexer_leaves_the_rest(text):
    assert secret_scan.lexed_spans(text) == []


def test_lexer_is_linear_in_hostile_text():
    for part in ("a.", "a-", 'a="', "a='b ", "a:", "<a>", "-", "pwd=a+", "a = a\n"):
        secret_scan.spans(part * 30000)


def test_scan_rows(spark):
    df = frame(spark, [(1, "token=abcdef1 x", "s"), (1, "token=abcdef1 x", "s"), (2, None, "s"), (None, "", "s")])
    assert sorted((r.doc_id or 0, len(r.spans)) for r in secret_scan.scan(df).collect()) == [(0, 0), (1, 1), (1, 1), (2, 0)]
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_names_are_told_by_whole_parts():
    high = ["authToken", "db_password", "API_KEY", "client.secret", "sshKey", "X-Auth-Token", "signing_key"]
    none = ["authors", "salted_caramel", "tokenizer", "monkey", "keyboard", "secretary", "passenger"]
    assert all(secret_scan.sensitivity(x) >= 0.6 for x in high) and not any(secret_scan.sensitivity(x) for x in none)
    assert secret_scan.sensitivity("token_count") < secret_scan.THRESHOLD


def test_literals_passed_to_sensitive_calls_are_found():
    secret = "q7Zr-92LmX_v4TbN8sKd"
    for text in (f'auth("{secret}")', f"PART = '{secret}'\nclient.login(user, PART)", f'set_password("bob", "{secret}")'):
        assert [text[a:b] for a, b, kind, *_ in secret_scan.spans(text) if kind == "lexed"] == [secret]
    assert not [x for x in secret_scan.spans(f'print("{secret}") range(a, b)') if x[2] == "lexed"]


def test_lexer_names_the_base_spans_it_confirms():
    got = secret_scan.spans('password = "q7Zr92LmXv4TbN8sKd"')
    assert [(kind, name) for _, _, kind, name, _ in got] == [("assign", "password")] and got[0][4] > 0.8


def test_planted_assignments_are_found_and_plain_ones_left():
    rng = random.Random(3)
    chars = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789-_"
    literal = lambda: "".join(rng.choices(chars, k=20)) + "Q7"
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    forms = ['{n} = "{v}"', "{n}: {v}", '"{n}": "{v}"', "export {n}='{v}'", "<{n}>{v}</{n}>", 'base = "{v}"\n{n} = base', '{n} := "{v}"']
    names = "db_passphrase signing_key authToken client.bearer my_credential ENC_SALT privateKey".split()
    calm = "authors salted_caramel tokenizer title monkey release_notes colour primary_column".split()
    found = lambda text: [text[a:b] for a, b, *_ in secret_scan.lexed_spans(text)]
    hits = wrong = 0
    for k in range(700):
        v, n = literal(), names[k % 7]
        hits += v in found(f"{word()} = 1\n" + forms[rng.randrange(7)].format(n=n, v=v) + f"\n{word()}: {word()}")
        wrong += bool(found(forms[k % 7].format(n=calm[k % 8], v=literal())))
    assert hits >= 0.97 * 700 and wrong == 0


# language ID and toxicity


def test_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in queries.documents(spark, sf_dir).collect()}
    got = queries.op1_language_mixture(spark, sf_dir).collect()
    apart = [r for r in got if r.held_out]
    assert {r.doc_id for r in apart} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == truth[r.doc_id] for r in apart) > 0.97 * len(apart)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(truth)


def test_mixtures_are_found_and_odd_texts_have_no_language(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    model = langid.learn(docs)
    by = {lang: " ".join(r.text for r in docs.where(F.col("lang") == lang).limit(4).collect())[:3000] for lang in ("en", "de")}
    rows = [(1, by["en"], "s"), (2, by["en"] + " " + by["de"], "s"), (3, None, "s"), (4, "12 !? 34", "s"), (5, "", "s"), (None, by["de"], "s"), (6, by["de"] * 60, "s")]
    got = {r.doc_id: r for r in langid.predict(frame(spark, rows), model).collect()}
    assert set(got[1].mixture) == {"en"} and set(got[2].mixture) == {"en", "de"} and got[None].lang_pred == got[6].lang_pred == "de"
    assert sum(got[2].mixture.values()) == pytest.approx(1, abs=1e-3)
    assert [got[k].lang_pred for k in (3, 4, 5)] == ["und"] * 3
    assert sorted(r.doc_id or 0 for r in langid.accepted(frame(spark, rows), model).collect()) == [0, 1, 2, 6]
    assert langid.learn(frame(spark, [(1, None, "s")])) is None and langid.learn(frame(spark, [])) is None
    assert [r.lang_pred for r in langid.predict(frame(spark, rows[:1]), None).collect()] == ["und"]


def test_many_languages_and_code_points_that_are_no_letters(spark):
    assert langid.trigrams("\U000f0000 \U000e0101 12") is None and langid.trigrams("\U00020000") is not None
    rows = [(k, f"wort{k} " * 20, f"l{k % 300}") for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert len(model.languages) > 200 and model.log_p.size <= langid.MODEL_SIZE
    assert langid.feature_bits(5) == 16 and langid.feature_bits(1 << 12) == 12
    assert langid.predict(docs, model).where("lang_pred = 'und'").count() == 0


def brute_mixture(p, counts):
    """Every set of languages, each by its own EM, from an even start; the set of the best penalised likelihood."""
    import itertools

    n, best = counts.sum(), (-np.inf, None)
    for size in range(1, p.shape[1] + 1):
        for chosen in itertools.combinations(range(p.shape[1]), size):
            q, pi = p[:, chosen], np.full(size, 1 / size)
            for _ in range(400):
                share = q * pi
                pi = (counts[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / n
            score = counts @ np.log(q @ pi) - 0.5 * np.log(n) * (size - 1)
            best = max(best, (score, dict(zip(chosen, pi, strict=True))), key=lambda x: x[0])
    return best


def test_mixtures_equal_brute_force_over_all_sets(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    model = langid.learn(docs)
    texts = [r.text[:400] for r in docs.orderBy("doc_id").limit(60).collect()]
    texts += [a[:150] + " " + b[:150] for a, b in zip(texts[:20], texts[20:40], strict=True)]
    same = 0
    for text in texts:
        grams = langid.trigrams(text)
        got = langid.infer(model, grams)
        feature, counts = np.unique(grams, return_counts=True)
        score, shares = brute_mixture(np.exp(model.log_p[feature].astype(np.float64)), counts.astype(np.float64))
        mine = got.log_likelihood - 0.5 * np.log(max(got.size, 2)) * (np.count_nonzero(got.proportions) - 1)
        assert mine <= score + 0.05 and mine >= score - 1.0
        same += int(np.argmax(got.proportions)) == max(shares, key=shares.get)
    assert same >= len(texts) - 1


def test_chain_on_labels_that_it_has_not_seen(spark):
    folder = "/root/testdata/sf0.1"  # a tenth of it has too few toxic documents to learn from
    docs, labels = queries.documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    chain = toxicity.train(docs, labels.where(~apart))
    got = toxicity.classify(docs, chain).join(labels.where(apart).withColumnRenamed("toxic", "truth"), "doc_id").select("toxic", "truth").collect()
    hits, all_toxic = sum(r.toxic and r.truth == 1 for r in got), sum(r.truth for r in got)
    false = sum(r.toxic and r.truth == 0 for r in got)
    print(len(got), all_toxic, hits, false)
    assert all_toxic > 50 and hits >= 0.8 * all_toxic and false <= 0.03 * (len(got) - all_toxic)


def test_words_of_a_fold_are_chosen_without_it():
    x = np.eye(4, dtype=np.float32)[np.arange(400) % 4]
    y = (np.arange(400) % 4 == 0).astype(np.float32)[:, None]
    chosen = {None: np.array([0, 1]), **{f: np.array([0, 2]) for f in range(4)}}
    chain = toxicity.fit_chain(("a", "b"), x, y, np.arange(400) // 100, ("p",), chosen)
    assert len(chain.weights[0]) == 3 and chain.probabilities(np.array([0]))[0] > 0.9


def test_chain_finds_toxic_words_of_unseen_documents(spark):
    rng = random.Random(5)
    calm = [f"w{k}" for k in range(60)]
    rows, labels, truth = [], [], {}
    for i in range(600):
        text = rng.choices(calm, k=30)
        if bad := i % 5 == 0:
            text += rng.sample(["scoundrel", "villain"], 1)
        if i % 7 == 0:
            text += ["junkjunk"]
        rows.append((i, " ".join(text), "s"))
        truth[i] = bad
        if i < 400:
            labels.append((i, 0 if i % 7 == 0 else 1, int(bad), "x"))
    rows += [(9000, None, "s"), (9001, "", "s"), (None, "villain", "s"), (1, "repeated", "s")]
    labels += [(None, 1, 1, "x"), (12345, 1, None, "x"), (3, 1, 0, "x")]
    docs = frame(spark, rows)
    chain = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))
    got = [r for r in toxicity.classify(docs, chain).collect() if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert all(r.toxic == truth[r.doc_id] for r in got) and all(r.low_quality == (r.doc_id % 7 == 0) for r in got)
    whole = toxicity.classify(docs, chain)
    assert whole.count() == len(rows) and whole.where("doc_id IN (9000, 9001) AND toxic").count() == 0
    assert toxicity.classify(docs.limit(0), chain).count() == 0
    empty = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.classify(docs, empty).where("doc_id = 9000").count() == 1


def test_out_of_fold_probabilities_feed_later_models():
    rng = np.random.default_rng(0)
    x = (rng.random((400, 3)) < 0.5).astype(np.float32)
    y = np.stack([x[:, 0], x[:, 0]], axis=1)
    chain = toxicity.fit_chain(("a", "b", "c"), x, y, np.arange(400) % 4, ("p", "q"))
    assert len(chain.weights[1]) == 3 + 1 + 1 and chain.weights[1][3] > 0


# the queries and their oracles


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)
