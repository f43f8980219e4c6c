"""Chat perspectives and URL filters against brute force, personal data on held-out labelled spans."""

import hashlib
import re

import numpy as np
import pytest
from plumbline.llm import chat, pii, url_filter


def render(turns, speaker):
    text, mask = "", []
    for role, body in turns:
        guard = lambda s: s.replace("<|", "<|‍")
        text += "<|system|>" if role == "system" else "<|assistant|>" if role == speaker else f"<|user:{guard(role)}|>"
        begin = len(text)
        text += guard(body) + "<|end|>"
        if role == speaker:
            mask.append(f"{begin}-{len(text)}")
        text += "\n"
    return text, ",".join(mask)


def test_every_participant_speaks_once_as_assistant(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|end|> 漢🙂"), (1, 2, "bob", ""), (1, 3, "ann", None), (1, 3, "ann", None), (2, None, "cy", "late"), (2, 5, None, "who"), (3, 0, "system", "alone"), (None, 0, "ann", "lost"), (4, 0, "x<|y", "z" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS speaker", "2 AS t", "3 AS turns")
    got = {(r.conv_id, r.speaker): r for r in chat.perspectives(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "cy"), (2, "unknown"), (4, "x<|‍y")}
    one = [("system", "Be kind."), ("ann", "Hi <|end|> 漢🙂"), ("bob", ""), ("ann", ""), ("ann", "")]
    for who in ("ann", "bob"):
        text, mask = render(one, who)
        assert got[1, who].text == text and (got[1, who].n_turns, got[1, who].n_learned) == (5, sum(r == who for r, _ in one))
        # Spark counts characters by code point, as Python does
        assert got[1, who].mask == mask
        spans = [tuple(map(int, m.split("-"))) for m in mask.split(",")]
        assert all(text[a:b].endswith("<|end|>") for a, b in spans)
    assert got[2, "cy"].text.startswith("<|user:unknown|>who")
    assert chat.perspectives(df.limit(0)).count() == 0


def brute(url, rules):
    def canon(u):
        u = re.sub(r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "", u)
        u = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*|^//", "", re.sub(r"#.*$", "", u))
        host = re.match(r"[^/?]*", u).group()
        rest = u[len(host) :]
        host = re.sub(r":[0-9]*$", "", host.rsplit("@", 1)[-1]).lower()
        host = re.sub(r"\.{2,}", ".", host).strip(".")
        path, q, query = rest.partition("?")
        out = []
        parts = re.sub("/+", "/", "/" + path).split("/")[1:]
        for k, s in enumerate(parts):
            if s == "..":
                out = out[:-1]
                if k == len(parts) - 1:
                    out.append("")
            elif s == ".":
                if k == len(parts) - 1:
                    out.append("")
            else:
                out.append(s)
        return host, "/" + "/".join(out), q + query

    if url is None or not (c := canon(url))[0]:
        return None
    host, path, query = c
    labels = host.split(".")
    hosts = [host] if re.fullmatch(r"\d+(\.\d+){3}", host) else [host] + [".".join(labels[-k:]) for k in range(2, url_filter.MAX_SUFFIX + 2) if k < len(labels)]
    segs = path.split("/")
    rests = [path + query, path] + ["/".join(segs[:k]) + "/" for k in range(1, url_filter.MAX_PREFIX + 1) if k < len(segs)]
    seen = {h + r: h for h in hosts for r in rests}
    best = None
    for i, p, a, k in rules:
        if p is None or a is None or not canon(p)[0]:
            continue
        e = "".join(canon(p))
        if e in seen:
            key = (-k, -len(seen[e]), -len(e), a, i)
            if best is None or key < best[0]:
                best = (key, a, i, e)
    return best


def test_urls_against_brute_force(spark):
    rng = np.random.default_rng(0)
    hosts = ["a.example.com", "b.a.example.com", "x.b.a.example.com", "EXAMPLE.com.", "u:p@example.org:80", "10.0.0.1", "deep.one.two.three.four.example.net", ""]
    paths = ["", "/", "/p", "/p/", "/p/q/r.html", "//p//q", "/p/./q", "/p/../q/", "/p/q/r/s/t/u?x=1&y=2", "?q=1", "/p#frag", "/..", "/p/.."]
    urls = [f"{rng.choice(['http://', 'https://', '//', '', 'HTTP://'])}{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "   ", "http://", " http://a.example.com/p \n", "http://a.example.com/" + "z/" * 5000, "http://a.example.com/p?" + "q" * 70_000]
    rules = [(k, str(rng.choice(["example.com", "a.example.com/p", "a.example.com/p/", "b.a.example.com", "example.org/p/q/", "10.0.0.1", "0.0.1", "example.net/", "a.example.com/?q=1", "example.com/p/q/r/"])), str(rng.choice(["block", "allow"])), int(rng.integers(0, 4))) for k in range(25)] + [(80, "10.0.0.1", "block", 7), (90, None, "block", 9), (91, "example.com", None, 9), (92, "", "block", 9)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(0, urls[0]), (None, urls[1])], "page_id long, url string").selectExpr("*", "'c' AS action", "1 AS prefix", "2 AS digest")
    table = spark.createDataFrame(rules, url_filter._RULE)
    got = url_filter.url_verdicts(pages, table).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        want = brute(r.url, rules)
        assert (r.action, r.rule_id, r.matched) == (("none", None, None) if want is None else want[1:]), r.url
    assert {r.action for r in got} == {"none", "block", "allow"}
    kept = url_filter.url_filter(pages, table)
    assert kept.columns == pages.columns and kept.count() == sum(r.action != "block" for r in got)
    assert {r.action for r in url_filter.url_verdicts(pages, table.limit(0)).collect()} == {"none"}
    assert url_filter.url_verdicts(pages.limit(0), table).count() == 0


@pytest.mark.parametrize("prefix_bytes", [1, 4])
def test_short_prefixes_are_confirmed_by_the_digest(spark, prefix_bytes, capsys):
    import collections

    hosts = [f"host{k}.example.com" for k in range(600)]
    first = collections.Counter(hashlib.sha256(f"{h}/".encode()).digest()[:1] for h in hosts)
    assert max(first.values()) > 3  # many collide in one byte
    rules = spark.createDataFrame([(k, h, "block", 0) for k, h in enumerate(hosts[::2])] + [(900, hosts[0], "allow", 0), (901, hosts[2], "block", 7)], url_filter._RULE)
    pages = spark.createDataFrame([(k, f"http://{h}/") for k, h in enumerate(hosts)], "page_id long, url string")
    out = url_filter.url_verdicts(pages, rules, prefix_bytes=prefix_bytes)
    got = {r.page_id: (r.action, r.rule_id) for r in out.collect()}
    want = {k: ("block", k // 2) if k % 2 == 0 else ("none", None) for k in range(600)} | {0: ("allow", 900), 2: ("block", 901)}
    assert got == want
    out.explain()
    joins = [x for x in capsys.readouterr().out.splitlines() if "Join" in x and "rule_prefix" in x]
    assert joins and not any("digest" in x for x in joins)


def test_many_rules_are_not_broadcast(spark, monkeypatch, capsys):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 2)
    pages = spark.createDataFrame([(1, "http://thther.example.org/a"), (2, "http://spam-farm.example.org/x")], "page_id long, url string")
    out = url_filter.url_verdicts(pages, url_filter.default_rules(spark))
    assert {(r.page_id, r.action) for r in out.collect()} == {(1, "allow"), (2, "block")}
    out.explain()
    assert any("SortMergeJoin" in x and "rule_prefix" in x for x in capsys.readouterr().out.splitlines())


@pytest.fixture(scope="module")
def tagger():
    return pii.default_tagger()


def test_held_out_spans(tagger):
    ids, tags = pii.training_texts(pii.Dice(987_654), 1500, 96)
    got = tagger.decode(ids)
    want, found = ({(i, *s) for i in range(len(ids)) for s in pii.spans(x[i] * (ids[i] != pii.PAD))} for x in (tags, got))
    # spans that a cut has left a piece of can't be told
    want = {s for s in want if s[1] > 0 and s[2] < 96}
    found = {s for s in found if s[1] > 0 and s[2] < 96}
    hit = len(want & found)
    assert hit / len(want) > 0.93 and hit / len(found) > 0.9


def test_gradients(tagger):
    rng = np.random.default_rng(3)
    score, tags, trans = rng.normal(size=(5, 2, pii.TAGS)), rng.integers(0, pii.TAGS, (2, 5)), rng.normal(size=(pii.TAGS, pii.TAGS))
    loss, ds, dt = pii._crf(score, tags, trans)
    for k in [(0, 0, 1), (3, 1, 2), (4, 0, 0)]:
        more = score.copy()
        more[k] += 1e-6
        assert abs((pii._crf(more, tags, trans)[0] - loss) / 1e-6 - ds[k]) < 1e-4
    more = trans.copy()
    more[2, 3] += 1e-6
    assert abs((pii._crf(score, tags, more)[0] - loss) / 1e-6 - dt[2, 3]) < 1e-4


def test_viterbi_against_all_paths(tagger):
    import itertools

    ids = np.array([pii.char_ids("a@b.")])
    e = tagger.emissions(ids)[:, :, 0]
    best = max(itertools.product(range(pii.TAGS), repeat=4), key=lambda p: sum(e[k, t] for k, t in enumerate(p)) + sum(tagger.trans[a, b] for a, b in zip(p, p[1:], strict=False)))
    assert tagger.decode(ids)[0].tolist() == list(best)


def composed(seed, n):
    """Texts of many lengths with personal data in them."""
    dice = pii.Dice(seed)
    out = []
    for k in range(n):
        text = ""
        while len(text) < [3, 40, 300, 520, 700, 1500, 4000][k % 7]:
            u = dice.random()
            text += ("".join(pii.personal(dice, dice.choice(pii.KINDS))) if u < 0.05 else pii.look_alike(dice) if u < 0.1 else pii._word(dice)) + " "
        out.append(text)
    return out


def one_pass(model, text):
    """The best tags of a whole text: windows one at a time, their scores blended, one Viterbi search through all of it."""
    ids = pii.char_ids(text)
    stride, fall = pii.WINDOW - pii.OVERLAP, 1 - (np.arange(pii.OVERLAP) + 0.5) / pii.OVERLAP
    score, n = np.zeros((len(ids), pii.TAGS)), max(1, -(-(len(ids) - pii.OVERLAP) // stride))
    for k in range(n):
        part = model.emissions(ids[None, k * stride : k * stride + pii.WINDOW])[:, :, 0]
        w = np.ones(len(part))
        if k:
            w[: pii.OVERLAP] = fall[::-1]
        if k + 1 < n:
            w[stride:] = fall
        score[k * stride : k * stride + len(part)] += w[:, None] * part
    return model._viterbi(score[:, :, None].astype(np.float32))[0]


def test_windows_against_one_pass(tagger):
    texts = composed(5, 70) + ["x", "1", "a@b.com", "4711 0815 1234 5678", ""]
    got = pii.tag_documents(tagger, [pii.char_ids(t) for t in texts])
    some = 0
    for t, tags in zip(texts, got, strict=True):
        want = one_pass(tagger, t) if t else np.zeros(0, np.uint8)
        assert tags.tolist() == want.tolist(), t
        some += len(pii.spans(tags))
    assert some > 100


def test_tags_do_not_depend_on_the_batch(tagger):
    texts = composed(8, 60)
    together = pii.tag_documents(tagger, [pii.char_ids(t) for t in texts])
    for t, tags in zip(texts, together, strict=True):
        assert pii.tag_documents(tagger, [pii.char_ids(t)])[0].tolist() == tags.tolist()


def test_a_kept_tagger_is_the_same(spark, tagger):
    back = pii.from_bytes(pii.to_bytes(tagger))
    assert all((a == b).all() for a, b in zip(vars(back).values(), vars(tagger).values(), strict=True))


def test_own_labelled_spans():
    texts = [(f"the key of box {k} is K-{k:05d} as agreed", [(len(f"the key of box {k} is "), len(f"the key of box {k} is ") + 7, "ID")]) for k in range(300)]
    model = pii.train(steps=150, labelled=texts)
    new = [f"the key of box {k} is K-{k:05d} as agreed" for k in range(40_000, 40_100)]
    got = [pii.spans(x) for x in pii.tag_documents(model, [pii.char_ids(t) for t in new])]
    assert sum(x == [(len("the key of box 40000 is "), len("the key of box 40000 is ") + 7, pii.KINDS.index("ID"))] for x in got) > 90


def test_whole_texts_across_windows(spark, tagger):
    mail, card = "anna.b42@mail7.example.com", "4711 0815 1234 5678"
    filler = "The men went on to the other side of the river and came back. "
    texts = []
    for shift in range(0, 120, 7):  # spans at every place about a window's end
        head = (filler * 20)[: pii.WINDOW - 80 + shift].rsplit(" ", 1)[0] + " "
        texts.append(head + mail + " and then " + filler * 3 + card + " " + filler)
    texts += [None, "", "x", filler * 2000 + mail, "no data here at all."]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, mail + " is it.")], "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS redacted")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for k, t in enumerate(texts[:-5]):
        assert [t[s.span_begin : s.span_end] for s in got[k].spans] == [mail, card], k
        assert mail not in got[k].redacted and "<EMAIL>" in got[k].redacted
    n = len(texts)
    assert set(got) == {*range(n - 5), n - 2, None}
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_deep_rules_meet_the_urls_below_them(spark):
    from pyspark.sql import functions as F

    rules = spark.createDataFrame([(1, "b.c.d.e.example.org", "block", 1), (2, "example.com/a/b/c/d/e/", "block", 1)], "rule_id long, pattern string, action string, priority int")
    urls = ["http://a.b.c.d.e.example.org/x", "http://b.c.d.e.example.org/x/y", "http://c.d.e.example.org/x", "http://example.com/a/b/c/d/e/f/g", "http://www.example.com/a/b/c/d/e/", "http://example.com/a/b/c/d/f"]
    bare = rules.withColumn("pattern", F.when(F.col("rule_id") == 1, F.concat("pattern", F.lit("/"))).otherwise(F.col("pattern")))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in (rules, bare):
        got = {x.page_id: x.rule_id for x in url_filter.url_verdicts(pages, r).collect()}
        assert got == {0: 1, 1: 1, 2: None, 3: 2, 4: 2, 5: None}
    assert {x.action for x in url_filter.url_verdicts(pages, rules.limit(0)).collect()} == {"none"}
