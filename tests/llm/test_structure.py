"""Filter audit, text of web pages and conversation repair against brute force and hand-made cases."""

import hashlib
import heapq
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from lorekeep.llm import conversation_repair, filter_audit
from lorekeep.llm.html_extraction import extract, main_text

WORD = r"[^\x20\x09-\x0D]+"


def brute_audit(docs, labels):
    """All orders, filter after filter, on lists of documents."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    ids, parts = defaultdict(list), defaultdict(list)
    for i, text, _ in docs:
        ids[text or ""].append(i)
    for i, text, lang in docs:
        x = text or ""
        w = re.findall(WORD, x)
        smaller = i is not None and any(j is not None and j < i for j in ids[x])
        fails = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", x)) > 10 * len(x), bool(re.search(r"[#$%&*|]", x)), smaller)
        parts[lang or ""].append((dict(zip("ABCDE", fails, strict=True)), i in good, i in toxic))
    for part, rows in parts.items():
        found, share = [], Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                here, left = [r for r in left if r[0][f]], [r for r in left if not r[0][f]]
                share[f] += len(here)
                redundant = sum(r[0][f] for r in rows) - len(here)
                alone = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                found.append((f, (part, "".join(order), step, len(left), len(here), redundant, alone, sum(r[1] for r in here), sum(r[2] for r in here))))
        yield from ((*row, share[f]) for f, row in found)


def test_filter_audit(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    want = Counter(brute_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]))
    assert Counter(map(tuple, filter_audit.filter_audit(docs, labels).collect())) == want


def test_filter_audit_odd_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "A#", "one", " ".join(f"w{i}" for i in range(120)), " ".join(f"W{i % 70}" for i in range(130)), "x|y " * 101]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(300)] + [(7, "one", "en")] * 3
    marks = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, lang string, n int, mask string")
    labels = spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, quality int, toxic int, part string")
    found = filter_audit.filter_audit(docs, labels).collect()
    assert Counter(map(tuple, found)) == Counter(brute_audit(rows, marks)) and len(found) == 3 * 600
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    assert filter_audit.filter_audit(docs, labels.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_removal_polynomial():
    rng = random.Random(2)
    counts = {m: rng.randrange(50) for m in range(8)}
    f = filter_audit.Removal(counts, 3)
    assert all(f.at(s) == sum(n for m, n in counts.items() if m & s) for s in range(8))
    assert [f.shapley(i) for i in range(3)] == [sum(filter_audit.Fraction(n, m.bit_count()) for m, n in counts.items() if m >> i & 1) for i in range(3)]


def brute_repair(rows, damage):
    """Dijkstra over (rows used, initials so far) with the edits as second key."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        name, copies = ":".join(" " if x is None else str(x) for x in (conv, turn)), 1
        role, text, kind = " " if role is None else role, " " if text is None else text, zlib.crc32(name.encode()) % 20 if damage else 9
        if kind == 0:
            copies = 0
        elif kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 3:
            copies = 2
        elif kind == 4:
            role = "user"
        turns[conv] += [(turn, role, text)] * copies
    after, roles = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}, {"u": "user", "a": "assistant"}
    for conv, left in turns.items():
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in left:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = {t for t, _, _ in left if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:], strict=False))
        heap, done = [(0, "", 0, "", ())], set()
        while heap:
            cost, audit, i, state, out = heapq.heappop(heap)
            if i == len(left) and state in ("", "a"):
                break
            if (i, state) in done:
                continue
            done.add((i, state))
            put = lambda more, edit, j, to, turn=None: heapq.heappush(heap, (cost + more, audit + edit, j, to, out + (turn,) if turn else out))  # noqa: B023, E731
            for x, role in roles.items():
                if (state, x) in after:
                    put(2, "I", i, after[state, x], (role, ""))
            if i < len(left):
                put(3, "D", i + 1, state)
                if faults[i] in ("", "truncated"):
                    extra, (_, own, text) = faults[i] == "truncated", left[i]
                    if (state, own[:1]) in after:
                        put(extra, "K", i + 1, after[state, own[:1]], (own, text))
                    for x, role in roles.items():
                        if (state, x) in after:
                            put(2 + extra, "R", i + 1, after[state, x], (role, text))
        text = "\n".join(f"{r}:{x}" for r, x in out)
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        yield conv, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def test_conversation_repair(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = Counter(map(tuple, conversation_repair.audits(conversation_repair.damaged(rows)).collect()))
    assert got == Counter(brute_repair(map(tuple, rows.collect()), True))


@pytest.mark.parametrize("damage", [True, False])
def test_conversation_repair_odd_rows(spark, damage):
    rng = random.Random(1)
    roles = ["system", "user", "assistant", "tool", "u", "", None, "aa", "System", "s"]
    texts = [None, "", " \n", "a.", "b", "c!", "d? ", "..", " x.\x0b", "a b c", "k.", "l.", "m", "n.", "o."]
    rows = [(rng.choice([None, *range(150)]), rng.choice([None, None, *range(-3, 12)]), rng.choice(roles), rng.choice(texts)) for _ in range(2000)]
    df = spark.createDataFrame([(*r, 0, b"") for r in rows], "conv_id long, turn long, role string, text string, n int, digest binary")
    frame = (conversation_repair.damaged if damage else conversation_repair.known)(df)
    got = conversation_repair.audits(frame).collect()
    assert Counter(map(tuple, got)) == Counter(brute_repair(rows, damage))
    turns = defaultdict(list)
    for r in sorted(conversation_repair.repaired(frame).collect(), key=lambda r: (str(r.conv_id), r.place)):
        turns[r.conv_id].append(r)
    for r in got:
        found = turns[r.conv_id]
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in found)) and [t.place for t in found] == list(range(1, len(found) + 1))
        assert "".join(t.edit for t in found) == r.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in found).encode()).hexdigest() == r.repaired_sha256
    assert conversation_repair.audits(frame.limit(0)).count() == 0


def test_conversation_repair_long_and_text_ids(spark):
    rows = [("c'1", i, ("user", "assistant", "system")[i * i % 3 if i % 50 else 2], f"t {i % 4000}.") for i in range(5000)] + [("ü", 1 << 62, "user", "x"), ("ü", -(1 << 62), "user", "x" * 300_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {tuple(r) for r in conversation_repair.audits(conversation_repair.known(df)).collect()}
    assert got == {(c, min(g, (1 << 63) - 1), *rest) for c, g, *rest in brute_repair(rows, False)}


PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p><p>no</p>';</script></head><body>{}</body></html>"
TEXT = "<h1>Head &amp; line</h1><p>First  paragraph,\nwith <b>bold</b> and <a href='/x'>a link</a>.</p><p>Second<br>one &lt;here&gt; caf&eacute; &#8212; end.<ul><li>item a<li>item b</ul><table><tr><td>c1<td>c2</table>"
WANT = "Head & line First paragraph, with bold and a link. Second one <here> café — end. item a item b c1 c2"
NOISE = (
    "<header class='site-header'><h1>My site</h1><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav></header>",
    "<div class='cookie-notice'><p>We use cookies to improve your experience on this site. <button>Accept</button></p></div>",
    "<aside class=sidebar><h3>Popular</h3><p>A long teaser text that is not part of the article at all, really not.</p></aside>",
    "<div id='sidebar-left'><p>About this blog and why we write it, at some length for good measure.</p></div>",
    "<form action=/s><input name=q><label>Search this site</label><select><option>one<option>two</select></form>",
    "<div class='advert'>Buy now, cheap as never before! Limited offer for new customers.</div><ins class=adsbygoogle>ad text</ins>",
    "<section id=comments><h2>3 comments</h2><article class=comment><p>Great text, I have read it twice and liked it a lot, thank you.</p></article></section>",
    "<div class='comment-list'><div class='comment-body'><p>Another reader writes a very long answer here that goes on and on for many words.</p></div></div>",
    "<div role=navigation><a href=1>one</a> <a href=2>two</a></div><div style='display: none'>hidden words</div><p hidden>more hidden</p>",
    "<!-- a comment <p>no</p> --><noscript>Enable scripts</noscript><svg><text>drawing</text></svg>",
    "<footer><p>&copy; 2024 Example company. All rights reserved, in all countries of the world.</p></footer>",
    "<div class='footer'>Imprint and contact of the publisher of this fine page</div>",
)
SHELLS = (
    "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div id=content>{}</div>", "<div class='post-content has-sidebar'>{}</div>",
    "<div><div><div class=entry>{}</div></div></div>", "<section class='article-body'>{}</section>", "<table><tr><td>{}</td></tr></table>",
)


@pytest.mark.parametrize("shell", SHELLS)
def test_html_text_in_many_shells(shell):
    rng = random.Random(len(shell))
    longer = TEXT + "".join(f"<p>{' '.join(rng.choice(['lorem', 'ipsum', 'dolor', 'sit', 'amet,']) for _ in range(rng.randrange(2, 60)))}.</p>" for _ in range(6))
    want = WANT + "".join(" " + x for x in re.findall(r"<p>((?:lorem|ipsum|dolor|sit|amet,)[^<]*)</p>", longer))
    assert main_text(PAGE.replace("{}", shell.replace("{}", longer))) == want
    for _ in range(20):
        before, after = rng.sample(NOISE, 4), rng.sample(NOISE, 4)
        assert main_text(PAGE.replace("{}", "".join(before) + shell.replace("{}", longer) + "\n".join(after))) == want
    inner = longer.replace("<p>Second", "".join(NOISE[1:8]) + "<p>Second")
    assert main_text(PAGE.replace("{}", shell.replace("{}", inner))) == want


def test_html_sections_stay_together():
    rng = random.Random(4)
    part = lambda n: "<div class=part><h2>Part</h2>" + "".join(f"<p>{'word ' * rng.randrange(4, 80)}end.</p>" for _ in range(n)) + "</div>"
    body = "<h1>Title</h1>" + part(9) + part(2) + part(1)
    text = " ".join(re.sub("<[^>]*>", " ", body).split())
    assert main_text(PAGE.replace("{}", NOISE[0] + f"<div class=story>{body}</div>" + NOISE[10])) == text
    assert main_text(PAGE.replace("{}", NOISE[0] + f"<article>{body}</article>" + NOISE[10])) == text


@pytest.mark.parametrize(("name", "gone"), [
    ("main-nav", True), ("siteFooter", True), ("cookieConsent", True), ("adBox", True), ("ad_top", True), ("side-bar", True), ("newsletter-signup", True), ("social-share", True), ("related-posts", True),
    ("commentThread", True), ("reader-comments", True), ("comment-section", True), ("page-header", True), ("advertising-slot", True), ("sponsored-content", True), ("skip-link", True),
    ("post-header", False), ("has-sidebar", False), ("no-comments", False), ("category-social", False), ("adventure", False), ("long-form", False), ("commentary", False), ("reading", False), ("article-text", False),
    ("navy", False), ("shareholders", False), ("page", False), ("", False),
])
def test_html_names(name, gone):
    extra = "Some words that stand here in a paragraph."
    page = PAGE.replace("{}", f"<article><h1>T</h1><div class='x {name}'><p>{extra}</p></div><p>The text of the article, with some words.</p></article>")
    assert (extra not in main_text(page)) == gone


@pytest.mark.parametrize(("source", "want"), [
    (None, ""), ("", ""), ("plain text", "plain text"), ("a < b &amp; c", "a < b & c"), ("<p>one<p>two", "one two"), ("<p>cut off <b>here", "cut off here"), ("<p>text</p><a hre", "text"),
    ("<p>text</p><!-- open", "text"), ("<p>a&nbsp;b c</p>", "a b c"), ("<p title='>'>x</p>", "x"), ("<nav><a href=/>x</a></nav>", ""), ("<P>UP</P><BR/>", "UP"), ("<div>one<div>two</div>three</div>", "one two three"),
    ("<p>wo<b>r</b>d</p>", "word"), ("<script>x</script>", ""), ("<p>&am</p>", "&am"), ("</p></div>x", "x"), ("<ul><li>a</ul>", "a"),
])
def test_html_small_cases(source, want):
    assert main_text(source) == want


@pytest.mark.parametrize("source", ["<a ", '<a "', "<div>", "<b><p>", "<", '<a href="x', "&", "<p>x", "<!--", "<script>", "<i>x<b>", "</i>", "<li><a href=x>y", "<td>"])
def test_html_time_is_linear(source):
    start = time.time()
    main_text(source * 30_000 + ">")
    assert time.time() - start < 5


def test_html_rows(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    got = {r.page_id: r for r in extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        from html import unescape

        assert got[r.page_id].text == " ".join(unescape(re.sub("</?(?:h1|p|b|br)>", " ", inner)).split()) and got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(1, None, 5, "k"), (1, None, 5, "k"), (2, "<p>x</p>", None, None)], "page_id int, html string, n_chars int, main_text string")
    assert sorted(map(tuple, extract(odd).collect())) == sorted([(1, "k", "", 0), (1, "k", "", 0), (2, None, "x", 1)], key=str)
    assert extract(odd.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pipeline_stages_take_odd_rows(spark, sf, kind):
    """Every stage but the last: nulls, empty and long texts, repeated rows, clashing names, ids of text, an empty table."""
    import corpus_pipeline

    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(n)) + "."
    good = [prose(120) for _ in range(4)]
    texts = [*good, good[0], good[1] + " tail", None, "", " \n\t", "short", "\n".join([good[2], prose(60), good[2]]), prose(60_000)]
    ids = [*range(len(texts) - 1), None]
    rows = [(None if i is None else i if kind == "long" else f"d{i}", t, "en", "src", None if t is None else len(t), 1, "m", b"d", 7) for i, t in zip(ids, texts, strict=True)]
    schema = f"doc_id {kind}, text string, lang string, source string, n_chars long, row_key int, minima string, digest binary, __lk_words int"
    docs = spark.createDataFrame([*rows, rows[3], rows[3], rows[6]], schema)
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, now = now.count(), stage(spark, now, sf)
            assert now.columns == docs.columns, name
            now = spark.createDataFrame(now.collect(), docs.schema)
            assert now.count() <= before
        packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).count()
        assert (packed == 0) == empty
        if not empty:
            left = {r["text"] for r in now.collect()}
            assert good[3] in left, [t[:20] for t in left]
            assert texts[-1] in left
            assert not {None, "short"} & left and sum(good[0] in t for t in left) == 1
