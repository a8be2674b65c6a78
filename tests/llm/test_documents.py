import ipaddress
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import langid, licenses, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts_equal_brute_force(make_docs, odd_texts):
    rng = random.Random(1)
    texts = [*odd_texts, *("\n".join(" ".join(rng.choice("ab c# é$") + rng.choice(("", "x")) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(30))) for _ in range(60))]
    rows = {r.doc_id: r for r in quality.line_first(make_docs(texts)).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), t
        assert not (r.kept and r.base_failed)
    assert quality.line_first(make_docs([])).count() == 0


def test_lines_are_judged_first():
    assert quality.line_fault("home | about | contact") == "navigation"
    assert quality.line_fault("WAS!! IT!! SO!! BAD!!") == "shouting"
    assert quality.line_fault("the the the the the the the the") == "repetition"
    assert quality.line_fault("All rights reserved.") == "boilerplate"
    assert quality.line_fault("A quiet sentence, with seven plain words.") is None
    assert quality.clean_lines("Good words are here.\nhome | about\n\nGood words are here.") == ("Good words are here.\n", 2, 4, 1)


def test_documents_that_lose_too_much_are_rejected(make_docs):
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    noise = "\n".join(f"a{i} | b{i} | c{i}" for i in range(40))
    rows = {r.doc_id: r.kept for r in quality.line_first(make_docs([prose, prose + "\n" + noise, None])).collect()}
    assert rows == {0: True, 1: False, 2: False}


def test_language_of_unseen_words_and_odd_texts(spark, make_docs, odd_texts):
    rng = random.Random(2)
    syllables = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["sch", "ung", "ei", "ber"], "cc": ["eau", "que", "oi", "tre"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4)))
    text = lambda lang: " ".join(word(lang) for _ in range(30))
    langs = [rng.choice(list(syllables)) for _ in range(300)]
    docs = spark.createDataFrame([(i, text(lang), lang) for i, lang in enumerate(langs)], "doc_id long, text string, lang string").withColumn("held", langid.is_held_out())
    model = langid.train(docs.where("not held"))
    found = langid.identify(docs, model).where("held").collect()
    assert len(found) > 30 and sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    odd = {r.doc_id: r for r in langid.identify(make_docs(odd_texts).drop("lang"), model).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and all(r.lang_pred == "und" or r.lang_pred in syllables for r in odd.values())
    assert langid.identify(docs, langid.train(docs.where("false"))).where("lang_pred <> 'und'").count() == 0


def test_backoff_uses_shorter_grams_for_unseen_words(spark):
    docs = spark.createDataFrame([(1, "schule schule schlecht schlecht", "de"), (2, "chateau chateau gateau gateau", "fr")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs[model.word("schuld").argmax()] == "de" and model.langs[model.word("bateau").argmax()] == "fr"
    assert not model.word("中").any()


def brute_language(rows, texts):
    """(language, score) of texts by the method's words, from dictionaries over all rows (text, lang)."""
    counts = {}
    for text, lang in rows:
        for w in re.findall(r"[^\W\d_]{1,40}", text.lower()):
            counts.setdefault((lang, 0), Counter())[w] += 1
            for n in range(1, 6):
                padded = w if n == 1 else f" {w} "
                counts.setdefault((lang, n), Counter()).update(padded[i : i + n] for i in range(len(padded) - n + 1))
    langs = sorted({lang for lang, _ in counts})
    size = {k: sum(c.values()) for k, c in counts.items()}

    def vector(n, gram):
        if not any(counts.get((lang, n), {}).get(gram, 0) > 0 for lang in langs):
            return None
        return [math.log(max(c, 0.3) if (c := counts.get((lang, n), {}).get(gram, 0)) > 0 else 0.3) - math.log(size.get((lang, n), 1)) for lang in langs]

    out = []
    for text in texts:
        total, words = [0.0] * len(langs), re.findall(r"[^\W\d_]{1,40}", text.lower())
        for w in words:
            found = vector(0, w)
            for n in range(min(5, len(w) + 2), 0, -1):
                if found is None:
                    padded = w if n == 1 else f" {w} "
                    parts = [padded[i : i + n] for i in range(len(padded) - n + 1)]
                    known = [v for v in (vector(n, p) for p in parts) if v]
                    if known and 2 * len(known) >= len(parts):
                        found = [min(2.0, len(parts) / n) / len(known) * sum(c) for c in zip(*known, strict=True)]
            if found is not None:
                found = [max(x - max(found), -6.0) for x in found]
                norm = math.log(sum(math.exp(x) for x in found))
                total = [t + x - norm for t, x in zip(total, found, strict=True)]
        share = [math.exp((t - max(total)) * min(1.0, 12 / len(words))) for t in total] if words else []
        best = max(range(len(langs)), key=lambda j: (share[j], -j)) if words else None
        out.append((langs[best], share[best] / sum(share)) if words else ("und", 0.0))
    return out


def test_languages_and_scores_equal_brute_force(spark, make_docs):
    rng = random.Random(12)
    parts = {"aa": "ka la mo ri tu", "bb": "ka sho gri mo zz", "cc": "щи ка мо ру", "zh": "天 地 人 山 水 火 风 木"}
    rows = []
    for lang, of in parts.items():
        of = of.split()
        words = ["".join(rng.choice(of) for _ in range(rng.randrange(1, 4))) for _ in range(40)]
        for _ in range(25):
            rows.append(("".join(rng.choice(of) for _ in range(120)) if lang == "zh" else " ".join(rng.choice(words) for _ in range(30)), lang))
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == sorted(parts)
    texts = ["".join(rng.choice("kalomrituszghiщуруа天地人山 ") for _ in range(rng.randrange(1, 60))) for _ in range(120)] + [t for t, _ in rows[::7]]
    found = {r.doc_id: r for r in langid.identify(make_docs(texts), model).collect()}
    for i, (lang, score) in enumerate(brute_language(rows, texts)):
        assert abs(found[i].score - score) < 1e-4 and (found[i].lang_pred == lang or score < 0.5), texts[i]
    assert all(found[len(texts) - len(rows[::7]) + k].lang_pred == lang for k, (_, lang) in enumerate(rows[::7]))


def test_rare_languages_are_learned_beside_large_ones(spark):
    rows = [(i, "the cat sat on the mat again and again", "en") for i in range(3000)] + [(9000 + i, "kissa istui matolla taas ja taas", "fi") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, max_docs=100, least=20)
    assert model.langs == ["en", "fi"] and model.langs[model.word("matolla").argmax()] == "fi"
    tiny = langid.train(docs, max_docs=1, least=1)
    assert "fi" in langid.train(docs, max_docs=1, least=8).langs and isinstance(tiny.langs, list)


PRIVATE = [
    "Write to ann.lee@corp.org or ANN.LEE@corp.org today.",
    "Call (743) 555-3824 or 743-555-3824, not (521) 555-6210.",
    "Card 4111 1111 1111 1111 and 4785380592391139 from 152.143.123.131.",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and DE89370400440532013000',
    "Mr. John Smith met Mary Smith. Later Mr. Smith left; Anna Müller stayed.",
    "Иван Петров и Мария Иванова здесь.",
    "nothing private at all in this one",
]


def brute_surrogates(texts, key):
    """Texts with surrogates, by the rounds of proposals in one loop."""
    found = [pii.entities(t) if t else [] for t in texts]
    open_ = sorted({(k, v) for f in found for _, _, k, v in f})
    originals = {(pii.family(k), v) for k, v in open_}
    held, table, attempt = set(), {}, 0
    while open_:
        won = {}
        for kind, value in open_:
            made = (pii.family(kind), pii.propose(key, kind, value, attempt))
            if made not in originals and made not in held:
                won.setdefault(made, (kind, value))
        held |= set(won)
        table |= {e: s for (_, s), e in won.items()}
        open_ = [e for e in open_ if e not in table]
        attempt += 1
    out = []
    for text, mentions in zip(texts, found, strict=True):
        parts, end = [], 0
        for start, to, kind, value in mentions:
            parts += (text[end:start], pii.render(table[kind, value], text[start:to], kind))
            end = to
        out.append(text if text is None else "".join(parts) + text[end:])
    return out, table


def test_surrogates_equal_brute_force_and_keep_classes(spark, make_docs, odd_texts):
    rng = random.Random(4)
    texts = [*PRIVATE, *odd_texts, "王小明先生和李女士。后来王小明走了。", "السيد أحمد البغدادي هنا", "mail 王小明@例子.cn now", "Mr. Paul Stone and Stone, said Paul."]
    hosts = ["10.1.2.{}", "172.16.4.{}", "169.254.7.{}", "192.0.2.{}", "8.8.4.{}", "224.0.0.{}"]
    texts += [f"from {h.format(rng.randrange(1, 255))} and {h.format(rng.randrange(1, 255))}" for h in hosts * 20]
    texts += [f"Mr. {rng.choice(('John', 'Paul'))} {rng.choice('ABCDEF')}{rng.choice(('orn', 'ell', 'ay'))}{k}" for k in range(5)] + [f"{c}@example.com" for c in "abcdefghijklmnopqrstuvwxyz"]
    found = {r.doc_id: r for r in pii.pseudonymise(make_docs(texts), b"key").collect()}
    want, table = brute_surrogates(texts, b"key")
    assert [found[i].text for i in range(len(texts))] == want
    by_family = Counter((pii.family(k), s) for (k, _), s in table.items())
    assert max(by_family.values()) == 1 and not {(pii.family(k), v) for k, v in table} & set(by_family)
    for (kind, value), made in table.items():
        if kind == "ipv4" and not value.startswith(("192.0.2", "224.")):
            assert ipaddress.ip_address(value).is_private == ipaddress.ip_address(made).is_private, (value, made)
            assert ipaddress.ip_address(value).is_link_local == ipaddress.ip_address(made).is_link_local
    assert "王" not in found[len(PRIVATE) + len(odd_texts)].text and "البغدادي" not in found[len(PRIVATE) + len(odd_texts) + 1].text
    assert re.search(r"mail [\u4e00-\u9fff]{3}@[\u4e00-\u9fff]{2}\.example now", found[len(PRIVATE) + len(odd_texts) + 2].text)


def test_names_of_all_kinds_get_different_surrogates(spark, make_docs):
    first = pii.propose(b"key", "given-m-latin", "john", 0)
    texts = ["Mr. John Smith is here", f"Mr. Paul {first.capitalize()} too", f"Mrs. {first.capitalize()} Stone"]
    rows = {r.doc_id: r.text for r in pii.pseudonymise(make_docs(texts), b"key").collect()}
    assert first.capitalize() not in " ".join(rows.values())


def test_surrogates_are_consistent_distinct_and_keep_formats(spark, make_docs, odd_texts):
    texts = [*PRIVATE, *odd_texts]
    rows = {r.doc_id: r for r in pii.pseudonymise(make_docs(texts), b"key").collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        if i >= 6:
            assert rows[i].text == t and rows[i].n_entities == 0
    for secret in ("ann.lee", "555-3824", "1111", "4785380592391139", "152.143.123.131", "24be64439e", "DE8937", "John", "Smith", "Mary", "Müller", "Петров", "Мария"):
        assert all(secret.casefold() not in rows[i].text.casefold() for i in range(6)), secret
    first, second = re.findall(r"[\w.]+@[\w.-]+\w", rows[0].text)
    assert first.casefold() == second.casefold() and second.split("@")[0].isupper()
    a, b, c = re.findall(r"\(?\d{3}\)?[ -]\d{3}-\d{4}", rows[1].text)
    digits = [re.sub(r"\D", "", x) for x in (a, b, c)]
    assert digits[0] == digits[1] != digits[2] and a[0] == "(" and b[3] == "-"
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", rows[2].text)[0].replace(" ", "")
    assert card[0] == "4" and pii._luhn(card) == 0
    assert re.search(r'token = "[0-9a-f]{40}"', rows[3].text)
    names = re.match(r"Mr\. (\w+) (\w+) met (\w+) (\w+)\. Later Mr\. (\w+) left", rows[4].text).groups()
    assert names[1] == names[3] == names[4] and names[0] != names[2]
    assert re.search(r"[а-я]", rows[5].text) and not re.search(r"[A-Za-z]", rows[5].text)
    again = {r.doc_id: r.text for r in pii.pseudonymise(make_docs(texts), b"key").collect()}
    other = {r.doc_id: r.text for r in pii.pseudonymise(make_docs(texts), b"other").collect()}
    assert again == {i: r.text for i, r in rows.items()} and other[0] != rows[0].text
    assert pii.pseudonymise(make_docs([]), b"key").count() == 0


def test_collisions_are_resolved(spark, monkeypatch):
    from tessera.llm.scratch import Scratch

    found = spark.createDataFrame([("phone", f"{i:02d}") for i in range(60)], "kind string, value string")
    monkeypatch.setattr(pii, "propose", lambda key, kind, value, attempt: f"{100 + (int(value) * 7 + attempt * 13) % 67}")
    rows = pii._assign(found, b"k", Scratch(spark, "t")).collect()
    assert len(rows) == 60 and len({r.surrogate for r in rows}) == 60 and not {r.surrogate for r in rows} & {f"{i:02d}" for i in range(60)}


def test_every_entity_gets_a_surrogate_where_a_format_has_too_few(make_docs):
    letters, hosts = "abcdefghijklmnopqrst", [f"{a:x}::{b:x}" for a in range(16) for b in range(1, 13)]
    texts = ["Password: ________\ntoken = ..........", *(f"write to {c}@example.com now" for c in letters), "write to _@example.com now", "Password: _______x", " ".join(hosts)]
    rows = {r.doc_id: r for r in pii.pseudonymise(make_docs(texts), b"key").collect()}
    assert rows[0].text == texts[0] and rows[0].n_entities == 0
    found = [re.fullmatch(r"write to (\w+@example\.com) now", rows[i].text)[1] for i in range(1, 22)]
    assert len(set(found)) == 21 and not set(found) & {f"{c}@example.com" for c in letters + "_"}
    assert rows[22].n_entities == 1 and re.fullmatch(r"Password: _{7}[a-z]", rows[22].text)
    made = rows[23].text.split(" ")
    assert rows[23].n_entities == len(set(made)) == len(hosts) and not set(made) & set(hosts)


def test_surrogates_outgrow_their_format():
    assert pii.propose(b"k", "ipv4", "192.168.3.4", 0).startswith("192.168.") and pii.propose(b"k", "ipv4", "192.168.3.4", pii.SAME_FORMAT).startswith("10.")
    later = pii.SAME_FORMAT + 1
    for kind, value, mention in (("phone", "2125553824", "(212) 555-3824"), ("ssn", "123456789", "123-45-6789"), ("iban", "de8937040044", "DE89 3704 0044"), ("mac", "001122aabbcc", "00:11:22:AA:BB:CC")):
        surrogate = pii.propose(b"k", kind, value, later)
        assert len(surrogate) == len(value) + 2
        assert re.sub(r"\W", "", pii.render(surrogate, mention, kind)).casefold() == surrogate
    card = pii.propose(b"k", "card", "4111111111111111", later)
    assert len(card) == 18 and pii._luhn(card) == 0


def test_whole_licences_and_notices(spark, make_docs, odd_texts):
    mit = next(t for name, t in licenses.LICENCES if name == "MIT")
    marked = "Copyright (c) 2024 Some Holder\n\n" + mit.upper().replace(",", "").replace("\n", "\r\n")
    british = mit.replace("merchantability", "merchantability").replace("sublicense", "sub-license")
    texts = [marked, british, mit + " And more.", "Prose.\nReleased under the MIT licence\nAll rights reserved.", *odd_texts]
    rows = {r.doc_id: r for r in licenses.scan_licenses(make_docs(texts)).collect()}
    assert len(rows) == len(texts)
    assert (rows[0].license, rows[1].license, rows[2].license) == ("MIT", "MIT", None)
    assert (rows[3].notices, rows[3].n_notices) == (["MIT", "proprietary"], 2)
    assert all(rows[i].license is None and rows[i].n_notices == 0 for i in range(4, len(texts)))
    assert rows[4].digest is None and licenses.scan_licenses(make_docs([])).count() == 0


def test_any_known_text_is_found_as_a_line(make_docs):
    own = [("MIT", licenses.LICENCES[0][1]), *((name, t) for name, t in licenses.LICENCES if name in ("Apache-2.0", "GPL-3.0-or-later", "Zlib", "ISC"))]
    texts = ["Prose.\n" + " ".join(t.split()) + "\nMore prose." for _, t in own]
    rows = {r.doc_id: r for r in licenses.scan_licenses(make_docs(texts)).collect()}
    assert [(rows[i].license, rows[i].notices, rows[i].n_notices) for i in range(len(own))] == [(None, [name], 1) for name, _ in own]
    known = licenses.known_digests(make_docs([]).sparkSession, [("Own", "Use it as you like."), ("None", "...")])
    rows = {r.doc_id: r for r in licenses.scan_licenses(make_docs(["a\n\n-- Use it, as you like\n...", "..."]), known).collect()}
    assert (rows[0].notices, rows[0].n_notices, rows[1].license, rows[1].n_notices) == (["Own"], 1, None, 0)


def test_long_licences_are_found_as_whole_texts(make_docs):
    known = dict(reversed(licenses.long_texts()))
    names = ["Apache-2.0", "CC0-1.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0"]
    assert sorted(known) == names and all(len(t) > 5000 for t in known.values())
    terms = known["Apache-2.0"].partition("APPENDIX:")[0]
    texts = [*(known[n].replace("\n", "\r\n") for n in names), terms, terms.replace("END OF TERMS AND CONDITIONS", ""), known["GPL-3.0-only"] + " And more."]
    rows = {r.doc_id: r.license for r in licenses.scan_licenses(make_docs(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == [*names, "Apache-2.0", "Apache-2.0", None]


def test_later_bare_and_upper_case_names_are_the_same_entity(make_docs):
    texts = ["John Smith came. Smith said no; John left. JOHN SMITH stayed. See Smith, John and Smith's book, but not Smithson.", "Smith is a trade here."]
    rows = {r.doc_id: r for r in pii.pseudonymise(make_docs(texts), b"key").collect()}
    given, name = rows[0].text.split(" ")[:2]
    assert rows[0].text == texts[0].replace("Smithson", "@").replace("John", given).replace("Smith", name).replace("JOHN", given.upper()).replace("SMITH", name.upper()).replace("@", "Smithson")
    assert given != "John" and name != "Smith" and rows[0].n_entities == 9 and (rows[1].text, rows[1].n_entities) == (texts[1], 0)
    assert [v for *_, v in pii.entities("Later Ahmed Hassan met Wei Chen.")] == ["ahmed", "hassan", "wei", "chen"]


def test_long_lists_are_joined_with_the_same_result(spark, make_docs, odd_texts):
    texts = [*odd_texts, *(t for _, t in licenses.LICENCES[:6]), *(f"some words\n{t}\nmore\n{t}" for _, t in licenses.NOTICES), "Released under the MIT License." + " " * 500, licenses.LICENCES[11][1].replace("\n", " ") + "\nand text"]
    usual = licenses.known_digests(spark)
    # Many more known texts, and each known one under a later name too.
    more = usual.unionByName(spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit("other").alias("license")))
    more = more.unionByName(usual.withColumn("license", F.concat(F.lit("~"), F.col("license"))))
    rows = [sorted(map(repr, licenses.scan_licenses(make_docs(texts), known).collect())) for known in (None, usual, more)]
    assert rows[0] == rows[1] == rows[2]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(repr, licenses.scan_licenses(make_docs(texts), more).collect())) == rows[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = {r.doc_id: r for r in licenses.scan_licenses(make_docs(texts)).collect()}
    assert found[len(texts) - 2].notices == ["MIT"] and found[len(texts) - 1].notices == ["Zlib"]


def test_lines_and_whole_texts_are_canonical_in_one_pass(spark, odd_texts):
    texts = [*odd_texts, "The sub\nlicence of the copyright\nowners, non\n-infringement\n\n(c) 2020 Me\nhttps://a", "a\r\nCopyright 2001 x\rb\n", "\n\n", "sub licence\nWhilst", *(t for _, t in licenses.LICENCES)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", licenses.canonical(F.col("t")).alias("whole"), licenses.canonical_lines(F.col("t")).alias("lines"))
    rows = rows.withColumn("again", licenses.canonical_of_lines(F.col("lines"))).withColumn("each", F.transform(F.split("t", "\n"), lambda x: licenses.canonical(x)))
    for r in rows.collect():
        assert r.whole == r.again and r.lines == r.each, r.t
    assert "sublicense of the copyright holders noninfringement http a" in rows.collect()[len(odd_texts)].whole


def test_short_languages_keep_what_was_seen_once(spark):
    rng = random.Random(5)
    long = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)), "aa") for k in range(40)]
    short = [(99, "żółw gęś jaźń", "bb"), (98, "ćma źrebię", "bb")]
    docs = spark.createDataFrame(long + short, "doc_id long, text string, lang string")
    model = langid.train(docs, most_entries=2000)
    per_lang = Counter(model.lang.tolist())
    assert per_lang[0] <= 2000 and per_lang[1] == len({(n, g) for _, t, _ in short for w in langid.letter_words(t) for n in range(langid.LONGEST + 1) for g in (langid.grams(w, n) if n else [w])})
    found = langid.identify(spark.createDataFrame([(1, "jaźń")], "doc_id long, text string"), model).first()
    assert found.lang_pred == "bb"
    assert langid._least_count({1: 10, 2: 5, 7: 3}, 8) == 2 and langid._least_count({1: 10}, 10) == 1 and langid._least_count({1: 11}, 10) == langid._MANY


def test_page_furniture_of_several_languages():
    for line in ("All rights reserved.", "Alle Rechte vorbehalten.", "Datenschutzerklärung und Nutzungsbedingungen unserer Seite", "Tous droits réservés", "Haz clic aquí para leer más", "Lees meer", "This site uses cookies.", "Log in", "Conditions d’utilisation du site"):
        assert quality.line_fault(line) == "boilerplate", line
    for line in ("I baked a cookie for him.", "She had to log in every day before work could start again.", "Er wollte sich bei der Schule anmelden und dann nach Hause gehen.", "The reader read more of the book than most others had."):
        assert quality.line_fault(line) is None, line
