"""Language, urls, toxicity, decontamination and personal data."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyhouse.llm import decontaminate, language, pii, toxicity, url_filter
from tallyhouse.llm.common import NO_ID
from tallyhouse.llm.queries import URL_RULES

HELD = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1]
OTHERS = [k for k in range(400) if k not in set(HELD)]


def prose(draw, syllables, n):
    return " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(n))


AA, BB = "ka lo mi ne pu ra so ti".split(), "sch ter ung ver bre dor gen lich".split()


@pytest.fixture(scope="module")
def languages():
    draw = random.Random(1)
    rows = [(k, prose(draw, AA if k % 2 else BB, draw.randint(5, 60)), "aa" if k % 2 else "bb") for k in range(300)]
    return rows + [(1000, None, "aa"), (1001, "", None), (1002, "12 34 !!", "bb"), (None, prose(draw, AA, 30), "aa"), rows[5], rows[5]]


def test_languages_are_told_apart(docs, languages):
    got = language.predict_language(docs(languages)).collect()
    assert len(got) == len(languages)
    label = {i: lang for i, _, lang in languages}
    held = [r for r in got if r["held_out"]]
    assert sorted({r["id"] for r in held}) == sorted(k for k in range(1003) if k in label and zlib.crc32(str(k).encode()) % 3 == 1)
    right = [r["lang_pred"] == label[r["id"]] for r in held if r["id"] < 1000]
    assert sum(right) / len(right) > 0.97
    empty = [(r["lang_pred"], r["score"]) for r in got if r["id"] in (1000, 1001, 1002)]
    assert empty == [("und", 0.0)] * 3 and all(0 <= r["score"] <= 1 for r in got)


def test_words_of_two_languages_in_one_text(docs, languages):
    model = language.fit(docs(languages))
    draw = random.Random(9)
    labels = language.label_words(model, prose(draw, AA, 25) + " " + prose(draw, BB, 25))
    assert sum(x == "aa" for _, x in labels[:25]) > 22 and sum(x == "bb" for _, x in labels[25:]) > 22


def test_marginals_do_not_depend_on_blocks(monkeypatch):
    import numpy as np

    draw = np.random.default_rng(5)
    model = language.Field(["a", "b", "c"], None, draw.normal(size=(3, 3)), draw.normal(size=3))
    scores, bounds = draw.normal(size=(330, 3)).astype("f4"), np.array([0, 1, 1, 131, 330])
    whole = model.marginals(scores, bounds)
    # Plain forward-backward in double precision.
    step, begin = np.exp(model.transitions), np.exp(model.starts)
    for low, high in ((0, 1), (1, 131), (131, 330)):
        e = np.exp(scores[low:high].astype(float))
        ahead, back = [begin * e[0]], [np.ones(3)]
        for t in range(1, len(e)):
            v = (ahead[-1] @ step) * e[t]
            ahead.append(v / v.sum())
        for t in range(len(e) - 1, 0, -1):
            v = step @ (e[t] * back[0])
            back.insert(0, v / v.sum())
        both = np.array(ahead) * np.array(back)
        assert np.allclose(both / both.sum(1, keepdims=True), whole[low:high], atol=1e-4)


def test_no_labels_no_language(docs):
    got = language.predict_language(docs([(1, "some text", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]
    assert language.predict_language(docs([])).count() == 0


URLS = [
    "http://Shop.COM/x", "https://a.example.com/en/1", "https://www.example.com/en/1?x=/net", "http://example.com/fr/", "http://x.net/es/a",
    "http://x.net/es", "http://net/fr/", "http://badexample.com/en/", "http://example.com", "ftp://a.b?q", "x", None, "", "http://:80/", "a://b://c/d",
    "http://y.org/z#f", "http://m.www.example.com/en/",
]


def rule_of(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text), default=None)


def test_rules_and_parts_of_urls(spark):
    pages = spark.createDataFrame([(k, u, "h", "clash") for k, u in enumerate(URLS)], "page_id bigint, url string, html string, label string")
    for r in url_filter.filter_urls(pages, URL_RULES).collect():
        host, path, rule = rule_of(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.text if rule else None)
        assert r["verdict"] == rule.verdict if rule else r["verdict"] in ("allow", "block")
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0
    one = url_filter.filter_urls(pages.where("url = 'http://y.org/z#f'"), URL_RULES).collect()
    assert [r["verdict"] for r in one] == ["allow"]


def test_trees_learn_from_the_rules(spark):
    rules = [url_filter.Rule("block", "bad.com", "/"), url_filter.Rule("allow", "good.com", "/")]
    rows = [f"http://bad.com/{k * 7919}/{k}/{k}?a={k}&b={k}" for k in range(200)] + [f"http://good.com/about-{'us' * (k % 3)}" for k in range(200)]
    rows += ["http://new.org/99881/12/12?a=12&b=13", "http://other.org/about-us"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, rules).collect()}
    assert (got[400], got[401]) == ("block", "allow")


def test_suffixes_count_all_labelled_urls_and_the_sample_holds_both_verdicts(spark):
    rules = [url_filter.Rule("block", "zz", "/bad/"), url_filter.Rule("allow", "zz", "/dab/")]
    hosts = [f"h{k}.zz" for k in range(150)]
    # Paths of the same letters: hosts alone tell the verdicts apart.
    rows = [f"http://{h}/{'bad/' if k % 2 else 'dab/'}{n}" for k, h in enumerate(hosts) for n in range(4)]
    rows += [f"http://{h}/page" for h in hosts]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string")
    few = [r for r in url_filter.filter_urls(pages, rules, max_train_rows=60).collect() if r["rule"] is None]
    right = [(r["verdict"] == "block") == bool(hosts.index(r["host"]) % 2) for r in few]
    assert len(few) == len(hosts) and sum(right) == len(right)
    copies = [f"http://h0.zz/dab/{k}" for k in range(3)] * 300 + [f"http://h1.zz/bad/{k}" for k in range(3)] + ["http://h1.zz/page"]
    pages = spark.createDataFrame(list(enumerate(copies)), "page_id bigint, url string")
    assert {r["block_score"] is not None for r in url_filter.filter_urls(pages, rules, max_train_rows=4).where("rule is null").collect()} == {True}


@pytest.fixture(scope="module")
def toxic():
    draw = random.Random(3)
    rows, labels = [], []
    for k in range(400):
        text = prose(draw, AA, draw.randint(20, 80))
        bad = k % 4 == 0
        if bad:
            words = text.split()
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(["grubwort", "schmutzig"]))
            text = " ".join(words)
        rows.append((k, text))
        labels.append((k, int(bad)))
    return rows + [(900, None), (901, ""), (None, "ka lo"), rows[8], rows[8]], labels


def test_toxic_words_are_found_when_hidden(spark, docs, toxic):
    rows, labels = toxic
    hidden = [(950, rows[1][1] + " gr0bw0rt 5chmutz1g grubwort"), (951, rows[1][1] + " s c h m u t z i g grub.wort"), (952, rows[2][1])]
    table = spark.createDataFrame(labels + [(77777, None), (None, 1)], "doc_id bigint, toxic int")
    got = toxicity.score_toxicity(docs(rows + hidden), table).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["id"]: r for r in got}
    held = [r for r in got if r["held_out"] and 0 <= r["id"] < 400]
    assert sum(r["predicted"] == int(r["id"] % 4 == 0) for r in held) / len(held) > 0.95
    assert [by_id[k]["predicted"] for k in (950, 951, 952, 900, 901, NO_ID)] == [1, 1, 0, 0, 0, 0]


def test_symbols_at_edges_doubled_letters_and_parted_words_are_restored(docs):
    words = "stupid idiot trash gucci also grass letter all wow to the dog is at".split()
    channel = toxicity.Channel(*toxicity.character_model(docs([(k, " ".join(words)) for k in range(50)])))
    restored = {
        "$tupid": "stupid", "!diot": "idiot", "@lso": "also", "tra$h": "trash", "gucc!": "gucci", "idiot!": "idiot", "(idiot)": "idiot",
        "stuupid": "stupid", "iidiot": "idiot", "letter": "letter", "wow!?!": "wow", "trash": "trash", '"$tupid",': "stupid",
    }
    assert {t: channel.words(t) for t in restored} == {t: [w] for t, w in restored.items()}
    assert channel.words("gra$$") == ["grass"] and channel.words("!!!") == [] and channel.words("...") == []
    import pyarrow as pa

    texts = ["i d i o t! to", "the stu pid dog", "st,up,id", "s t u pid", "is at", "i d i", "o t", None]
    seen: dict[str, int] = {}
    rows, found, _ = toxicity._hits(channel, pa.array(texts), lambda x: seen.setdefault(x, len(seen)), {})
    names = {n: x for x, n in seen.items()}
    by_text = [{names[f] for f in found[rows == k]} for k in range(len(texts))]
    assert "idiot" in by_text[0] and all("stupid" in by_text[k] for k in (1, 2, 3))
    assert "idiot" not in by_text[5] | by_text[6] and by_text[4] == {"is", "at"} and not by_text[7]


def test_scores_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r["score"] for r in toxicity.score_toxicity(docs([(1, "a"), (2, None)]), none).collect()] == [0.5, 0.5]
    assert toxicity.score_toxicity(docs([]), none).count() == 0


def test_benchmark_items_are_found(spark, docs):
    draw = random.Random(8)
    items = [(k, prose(draw, BB, 20) + ".\n" + prose(draw, BB, 8)) for k in range(30)] + [(90, None), (91, " "), (92, items_text := prose(draw, BB, 6)), (3, "lich ung")]
    rows, want = [], Counter()
    for k in range(60):
        words = prose(draw, AA, draw.choice([0, 5, 200, 700])).split()
        if k % 3 == 0:
            at = draw.randint(0, len(words))
            words[at:at] = [items[k % 30][1].upper() if k % 2 else items[k % 30][1]]
            want[k, k % 30] += 1
        elif k % 3 == 1:
            words.append(items[k % 30][1].split("\n")[0])  # the question alone
        rows.append((k, " ".join(words)))
    rows += [(500, None), (None, items[4][1] + " " + items_text), rows[0], rows[0]]
    want[0, 0] += 2
    want[NO_ID, 4] += 1
    want[NO_ID, 92] += 1
    table = spark.createDataFrame(items, "item_id bigint, text string")
    for most in (20_000, 7):
        got = Counter((r["id"], r["item_id"]) for r in decontaminate.contaminated(docs(rows), table, max_items=most).collect())
        assert got == want
    assert decontaminate.contaminated(docs([]), table).count() == 0
    assert decontaminate.contaminated(docs(rows), table.limit(0)).count() == 0


def test_search_loses_no_item_above_the_threshold():
    draw = random.Random(2)
    words = [prose(draw, BB, 1) for _ in range(60)]
    items = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(1, 25)))) for k in range(50)]
    index = decontaminate.Index.of(items, 0.5)
    index.prepare()
    import numpy as np

    for _ in range(200):
        terms = np.unique(np.array([index.terms.index(w) for w in draw.sample(words, draw.randint(1, 40)) if w in index.terms], dtype=np.int64))
        if not len(terms):
            continue
        scores = np.zeros(len(index.ids))
        for t in terms:
            scores[index.items[index.at[t] : index.at[t + 1]]] += index.impacts[index.at[t] : index.at[t + 1]]
        may = index.candidates(np.zeros(len(terms), np.int64), terms, 0.5)
        found = {k for k, _ in index.search(terms, may[:, 1], 0.5)}
        assert found == set(np.flatnonzero(scores >= 0.5 - 1e-12).tolist())


BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda h: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda h: all(int(p) <= 255 for p in h.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda h: 16 <= len(d := re.sub("[^0-9]", "", h)) <= 19 and luhn(d)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda h: 8 <= len(re.sub("[^0-9]", "", h)) <= 15),
)


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def spans_of(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in p.finditer(text or "") if ok(m.group())]


ODD = [
    "a@b.cc@d.ee", "a@b.c_d@e.f", "x@y", "é me@x.org, é", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.01", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "+1 (743) 555-3824", "++1234567890 +1", "日本 a.b@c.d 😀 9.9.9.9 z", None, "", "a@" + ".b" * 5000, "9" * 20000, "a" * 50000, "1 " * 9000 + "x", "@@@",
    "tel +49 30 1234567 or 10.0.0.1\nmail q@w.e", "4111 1111 1111 1111 4111 1111 1111 1111",
]


def test_spans_equal_those_of_plain_patterns(docs):
    rows = [*enumerate(ODD), (3, ODD[3]), (3, ODD[3]), (None, ODD[10])]
    got = pii.span_digest(docs(rows)).collect()
    have = Counter((r["id"], r["spans"]) for r in got)
    assert have == Counter((NO_ID if i is None else i, ",".join(spans_of(t))) for i, t in rows)
    assert pii.span_digest(docs([])).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=list(__import__("hypothesis").HealthCheck))
@given(st.lists(st.text(alphabet="a1@.+ -(é\n", max_size=40), min_size=30, max_size=60))
def test_spans_of_random_texts(docs, rows):
    got = Counter((r["id"], r["spans"]) for r in pii.span_digest(docs(list(enumerate(rows)))).collect())
    assert got == Counter((k, ",".join(spans_of(t))) for k, t in enumerate(rows))


def test_terms_that_disclose_an_entity_are_found(docs):
    draw = random.Random(4)
    rows = [(k, prose(draw, AA, 6) + f" Zauberfrosch writes from frosch@teich.org {prose(draw, AA, 6)}") for k in range(5)]
    rows += [(50 + k, prose(draw, AA, 8) + f" mail user{k}@x{k}.org " + prose(draw, AA, 5)) for k in range(200)]
    rows += [(400 + k, prose(draw, AA, 8) + " writes from ") for k in range(40)] + [(600, None), (None, "no data")]
    found = pii.find_spans(docs(rows)).where("kind = 'term'").collect()
    texts = dict(rows)
    assert {texts[r["id"]][r["start"] : r["end"]] for r in found} == {"Zauberfrosch"} and len(found) == 5
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(rows)).collect()}
    assert len(clean) == len(rows) and clean[600] is None and clean[400] == texts[400]
    assert clean[0] == texts[0].replace("Zauberfrosch", "").replace("frosch@teich.org", "[EMAIL]")
    assert clean[50] == texts[50].replace("user0@x0.org", "[EMAIL]")


def test_disclosing_terms_are_marked_in_all_texts_and_found_across_lines(docs):
    draw = random.Random(6)
    rows = [(k, prose(draw, AA, 6) + f"\nName: Wasserlurch\n\nMail: lurch@teich.org {prose(draw, AA, 6)}") for k in range(8)]
    rows += [(1000 + k, prose(draw, AA, 8) + f"\nName: {prose(draw, AA, 1)}\n\nMail: user{k}@x{k}.org " + prose(draw, AA, 5)) for k in range(400)]
    alone = [(9000, "\U0001f600 seen:\t(WASSERLURCH), wasserlurch!\n\n Wasserlurch"), (9001, "Wasserlurch"), (None, "no Wasserlurche")]
    rows += [*alone, alone[0]]
    clean = sorted(((r["doc_id"] or 0, r["text"]) for r in pii.sanitise(docs(rows)).collect() if r["doc_id"] is None or r["doc_id"] >= 9000))
    mark = "[NEAR EMAIL]"
    want = f"\U0001f600 seen:\t({mark}), {mark}!\n\n {mark}"
    assert clean == [(0, "no Wasserlurche"), (9000, want), (9000, want), (9001, mark)]
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(rows)).collect()}
    assert got[0] == dict(rows)[0].replace("Wasserlurch", mark).replace("lurch@teich.org", "[EMAIL]")


def test_all_columns_survive_sanitising(docs):
    rows = docs([(1, "call +1 (743) 555-3824 or a@b.cc x"), (2, None)])
    got = pii.sanitise(rows)
    assert got.columns == rows.columns and got.where("doc_id = 1").first()["text"] == "call [PHONE] or [EMAIL] x"
    rest = lambda df: sorted(map(repr, (r.asDict() for r in df.drop("text").collect())))
    assert rest(got) == rest(rows)


def test_tokens_that_are_not_decoded_hide_nothing(docs):
    """A token is passed over only where no lexicon feature can be read into it: the same hits as when all are decoded."""
    import pyarrow as pa

    draw = random.Random(11)
    words = ["stupid", "idiot", "trash", "moron", "hello", "garden", "window", "silly", "loss", "book", "letter", "summer"]
    channel = toxicity.Channel(*toxicity.character_model(docs([(k, " ".join(draw.choices(words, k=40))) for k in range(60)])))
    signs = {c: [s for s, given in toxicity.LEET.items() if c in given] for c in "abcdefghijklmnopqrstuvwxyz"}

    def written(word):
        out = ""
        for c in word:
            c = draw.choice(signs[c]) if signs[c] and draw.random() < 0.3 else c
            out += c * draw.choice([1, 1, 1, 2, 3, 4]) + draw.choice(["", "", "", " ", ".", "-"])
        return draw.choice(["", "$", "!", "("]) + out + draw.choice(["", "!", "?!", "$"])

    column = pa.array([" ".join(written(draw.choice(words)) for _ in range(30)) for _ in range(60)], pa.string())
    features = {f: k for k, f in enumerate([x for w in words[:4] + words[7:10] for x in toxicity.features_of(w)])}
    plain = toxicity._hits(channel, column, features.get, {})
    quick = toxicity._hits(channel, column, features.get, {}, toxicity.reading(list(features)))
    assert len(plain[0]) > 100
    assert sorted(zip(*(x.tolist() for x in plain[:2]))) == sorted(zip(*(x.tolist() for x in quick[:2])))
    assert toxicity.reading([f"{a}{b}x" for a in "abcdefghijklmnopqrstu" for b in "abcdefghijklmnopqrstu"]) is None and toxicity._readable(["x"], toxicity.reading([])) == [False]
    # Linear in the token, whatever it holds.
    assert toxicity._readable(["1" * 200_000 + "|$" * 50_000], toxicity.reading(list(features))) is not None
