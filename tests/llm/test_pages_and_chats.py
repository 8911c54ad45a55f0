"""URL filters, HTML extraction and chat formatting."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from entwine.llm import chat_format, html_extract, url_filter
from entwine.llm.catalog import RULES

PAGES = "page_id long, url string, html string"


def rule_of(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    path = rest[:end]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.written), default=None)
    return host, path, best and best.written, best and best.verdict


URLS = [None, "", "no scheme.net/", "http://A.Example.NET/en/1?q=http://x.org/fr/", "https://example.net", "ftp://b.net/x#y", "http://example.com/de/", "http://www.example.com/de/1", "http://notexample.com/de/1", "http://x.org/fr/", "http://x.org?y=/fr/", "http://x.example.com/en/", "a\n://z.net/\nq", "http://Ünï.NET/"]


def test_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(99, URLS[3], "<p>")]
    found = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, PAGES).withColumn("host", F.lit(1)), RULES).collect()}
    for i, u, _ in rows:
        host, path, rule, verdict = rule_of(u)
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule), u
        assert found[i]["verdict"] == verdict if verdict else found[i]["verdict"] in ("allow", "block")
    assert url_filter.judge(spark.createDataFrame([], PAGES), RULES).collect() == []


def test_distrust_flows_against_links(spark):
    link = lambda *hosts: "".join(f'<a HREF="https://{h}/x">l</a>' for h in hosts)
    rows = [(1, "http://bad.net/", link("other.info")), (2, "http://farm.info/", link("bad.net")), (3, "http://good.org/fr/", link("friend.info")), (4, "http://friend.info/", link("good.org")), (5, "http://other.info/", None), (6, "http://far.info/", link("farm.info"))]
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, PAGES), RULES, rounds=6).collect()}
    assert found == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block"}


def test_distrust_reaches_far_hosts(spark):
    rows = [(i, "http://h0.net/", None) for i in range(1000)]
    rows += [(1000 + i, f"http://h{i}.info/", f'<a href="//h{i - 1}.{"info" if i > 1 else "net"}/x">l</a>') for i in range(1, 13)]
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, PAGES), RULES).collect()}
    assert set(found.values()) == {"block"} and len(found) == 1012
    links = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long")
    mass = {r["host"]: r["mass"] for r in url_filter.propagate(links, spark.createDataFrame([("a", 1)], "host string, weight long"), None, 0.5, 1e-3).collect()}
    assert abs(mass["a"] - 2 / 3) < 1e-3 and abs(mass["b"] - 1 / 3) < 1e-3


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body><header>H</header><nav><ul><li>menu</ul></nav>
<div class="cookie-notice">C</div><div id='ad'>buy</div><!-- x --><article><h1>Title  of
 it</h1><p>One <b>t</b>wo &amp;amp; &lt;x&gt; caf&eacute;<br>next<p>Three<form><input>f</form><aside>s</aside><section id=comments><p>c</p></section></article><footer>F</footer>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Title of it One two &amp; <x> café next Three"
    assert html_extract.main_text("<main>a<p>b</main><p>c") == "a b"
    assert html_extract.main_text("plain &lt; text") == "plain < text"
    assert html_extract.main_text("<p>cut off <b") == "cut off"
    assert html_extract.main_text("<div>" * 3000 + "deep") == "deep"
    assert html_extract.main_text("") == "" and html_extract.main_text("<script>only</script>") == ""


def test_alignment_pairs_the_most_nodes():
    one, other = html_extract.parse("<div><p>a</p><ul><li>x</ul><p>b</p></div>"), html_extract.parse("<div><p>a</p><p>new</p><ul><li>x</ul><p>b</p></div>")
    pairs = [(a.words, b.words) for a, b in html_extract.aligned(one, other) if a.name == "#"]
    assert pairs == [("a", "a"), ("x", "x"), ("b", "b")] or sorted(pairs) == [("a", "a"), ("b", "b"), ("x", "x")]


def most_pairs(one, other):
    """The recursion of simple tree matching without any shortcut: (pairs, pairs of equal words)."""
    if one.name != other.name:
        return 0, 0
    rows = [[(0, 0)] * (len(other.nodes) + 1)]
    for a in one.nodes:
        row = [(0, 0)]
        for q, b in enumerate(other.nodes):
            own = most_pairs(a, b)
            row.append(max(rows[-1][q + 1], row[q], (rows[-1][q][0] + own[0], rows[-1][q][1] + own[1])))
        rows.append(row)
    return rows[-1][-1][0] + 1, rows[-1][-1][1] + (one.name == "#" and one.words == other.words)


@pytest.mark.parametrize("cells", [250_000, 1])
def test_alignment_is_a_maximum(monkeypatch, cells):
    monkeypatch.setattr(html_extract, "MOST_CELLS", cells)
    one = html_extract.parse("<body><div><ul><li>menu</ul></div><div><p>a</p></div></body>")
    other = html_extract.parse("<body><div><p>promo</p></div><div><ul><li>menu</ul></div><div><p>b</p></div></body>")
    assert ("menu", "menu") in [(a.words, b.words) for a, b in html_extract.aligned(one, other)]
    rng = random.Random(3)

    def tree(depth):
        name = rng.choice(["div", "p", "ul", "#"]) if depth else "root"
        return html_extract.Node(name, rng.choice("abcdef")) if name == "#" else html_extract.Node(name, nodes=[tree(depth + 1) for _ in range(rng.randint(0, 5 if depth < 3 else 0))])

    for _ in range(150):
        one, other = tree(0), tree(0)
        pairs = html_extract.aligned(one, other)
        assert (len(pairs), sum(a.name == "#" and a.words == b.words for a, b in pairs)) == most_pairs(one, other)
        assert len({id(a) for a, _ in pairs}) == len({id(b) for _, b in pairs}) == len(pairs)
    one = html_extract.Node("root", nodes=[html_extract.Node("#", i) for i in range(700 if cells > 1 else 30)])  # beyond 250,000 cells
    other = html_extract.Node("root", nodes=[html_extract.Node("#", -1)] + one.nodes[:20] + [html_extract.Node("#", -2)] + one.nodes[20:-1] + [html_extract.Node("#", -3)])
    assert sum(a.words == b.words for a, b in html_extract.aligned(one, other) if a.name == "#") == len(one.nodes) - 1


@pytest.mark.parametrize("sent", [200_000, 0])
def test_templates_are_constant_blocks(spark, monkeypatch, sent):
    monkeypatch.setattr(html_extract, "MOST_SENT", sent)
    rows = [(i, f"http://h.org/{i}", f"<body><p>Always here on top</p><div><p>Story number {i} is new</p></div><p>All rights kept</p></body>") for i in range(6)]
    rows += [(10, "http://alone.org/", "<p>Always here on top</p>"), (11, None, "<p>no host"), (12, "http://h.org/n", None), (13, "http://same.org/1", "<p>s"), (14, "http://same.org/2", "<p>s"), (15, "http://same.org/3", "<p>s"), (0, rows[0][1], rows[0][2])]
    found = sorted((r["page_id"], r["text"]) for r in html_extract.extract(spark.createDataFrame(rows, PAGES).withColumn("text", F.lit(0)).repartition(3)).collect())
    assert found == sorted([(i, f"Story number {i} is new") for i in range(6)] + [(10, "Always here on top"), (11, "no host"), (12, ""), (13, "s"), (14, "s"), (15, "s"), (0, "Story number 0 is new")])
    assert html_extract.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_constant_blocks_inside_articles_go(spark):
    rows = [(i, f"http://h.org/{i}", f"<article><h1>Story {i}</h1><div class=x1><p>Read more of us every day</p></div><p>Body {i} of it</p><p>Read more of us every day</p></article>") for i in range(6)]
    rows[5] = (5, rows[5][1], rows[5][2].replace("<p>Body 5 of it</p>", "<ul><li>Read more of us every day</ul>"))
    rows += [(20 + i, "http://copy.org/", "<article><h1>One</h1><p>text</article>") for i in range(8)]  # copies are one page
    rows += [(30, "http://copy.org/x", "<article><h1>Two</h1><p>text</article>"), (31, "http://copy.org/y", "<article><h1>One</h1><p>more</article>")]
    found = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert [found[i] for i in range(5)] == [f"Story {i} Body {i} of it" for i in range(5)]
    assert found[5] == "Story 5 Read more of us every day"  # the same words elsewhere are no template
    assert {found[i] for i in range(20, 28)} == {"One text"} and (found[30], found[31]) == ("Two text", "One more")


TURNS = "conv_id long, turn long, role string, text string"
TEXTS = ["</s>[INST] ok [/INST]", "a\\b \\<|end|>", "<|turn|>user<|text|>x<|end|>", "", None, "\\", "[\\INST]", "<<|end|>", "<<SYS>> <</SYS>>", "日本😀\n\r\n", "$1 \\\\1"]


def test_round_trip_of_any_text(spark):
    rows = [(i, 0, "user", t) for i, t in enumerate(TEXTS)] + [(i, 1, "assistant", t) for i, t in enumerate(TEXTS)]
    rows += [(50, 2, "assistant", "b"), (50, None, None, "first"), (50, 1, "too<|text|>l", "x"), (50, 2, "assistant", "b"), (None, 0, "user", "q")]
    chats = chat_format.format_chats(spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit(1)).repartition(3))
    found = {r["conv_id"]: r for r in chats.select("conv_id", "valid", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss_text(F.col("segments")).alias("loss")).collect()}
    assert len(found) == len(TEXTS) + 2
    for i, t in enumerate(TEXTS):
        own = found[i]
        assert [(x["role"], x["text"]) for x in own["turns"]] == [("user", t or ""), ("assistant", t or "")] and own["loss"] == (t or "") and own["valid"]
        body = own["formatted"][3:].replace("<|turn|>user<|text|>", "", 1).replace("<|turn|>assistant<|text|>", "", 1).replace("<|end|>", "", 2)
        assert not any(c in body for c in chat_format.Template().controls)
    assert [x["role"] for x in found[50]["turns"]] == ["", "too<|text|>l", "assistant", "assistant"] and found[50]["loss"] == "bb" and not found[50]["valid"]
    assert not found[None]["valid"]
    assert chat_format.format_chats(spark.createDataFrame([], TURNS)).collect() == []


def test_machine(spark):
    cases = {"user assistant": True, "system user assistant user assistant": True, "user": False, "assistant": False, "user user assistant": False, "system system user assistant": False}
    rows = [(i, n, r, "t") for i, roles in enumerate(cases) for n, r in enumerate(roles.split())]
    found = {r["conv_id"]: r["valid"] for r in chat_format.format_chats(spark.createDataFrame(rows, TURNS)).collect()}
    assert [found[i] for i in range(len(cases))] == list(cases.values())


def test_queries_give_their_columns(spark):
    from entwine.llm import catalog

    chats = catalog.op9_chat_format(spark, "/root/testdata/sf0.001")
    own = chats.where("conv_id = -7").first()
    assert own["n_turns"] == 2 and own["loss_sha256"] == hashlib.sha256(catalog.ADDED_TEXT.encode()).hexdigest()


def test_tags_that_only_look_like_others():
    text = html_extract.main_text
    assert text("<article><p>one</p><title-bar>x</title-bar><p>two</p></article>") == "one x two"
    assert text('<div class="content with-sidebar"><p>the whole article') == "the whole article"
    assert text("<article><p>if 1 < 2 then the rest") == "if 1 < 2 then the rest"
    assert text('<article><p>a < b</p><p>kept</p><p class="cut o') == "a < b kept"
    assert text('<div class="site-sidebar"><p>only this</p></div>') == "only this"
    assert text('<div class="site-sidebar"><p>aside</p></div><p>text</p>') == "text"
    assert text("<div>" * 3000 + "deep &amp; down" + "</div>" * 3000 + "<p>" + "long " * 200_000) == "deep & down " + ("long " * 200_000).strip()


def test_two_layouts_of_one_host(spark):
    """Each layout has constant blocks of its own, which are in too few of the host's pages to be constant there."""
    rows = []
    for i in range(12):
        own = f"<p>story {i} told {chr(97 + i)} at length</p>"
        if i % 2:
            rows.append((i, "http://h.example/a", f"<body><article><h2>Read this first</h2>{own}<p>Shared by all of us</p></article></body>"))
        else:
            rows.append((i, "http://h.example/b", f"<body><div><section><p>Quoted from the archive</p><blockquote>{own}</blockquote></section></div></body>"))
    found = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"story {i} told {chr(97 + i)} at length" for i in range(12)}


def ranks_of(links, seeds, damping=0.85):
    """Personalised PageRank by its definition, until nothing moves; mass of hosts without links out is not handed on."""
    out, base = {}, {h: w * (1 - damping) for h, w in seeds.items() if w > 0}
    for src, dst in links:
        out.setdefault(src, []).append(dst)
    mass = dict(base)
    for _ in range(400):
        new = dict(base)
        for src, m in mass.items():
            for dst in out.get(src, []):
                new[dst] = new.get(dst, 0.0) + damping * m / len(out[src])
        mass = new
    return mass


def test_verdicts_match_brute_force_ranks(spark, monkeypatch):
    """A random graph of hosts, with links without a scheme, inside hosts and to unknown hosts: mass moves both ways and decides."""
    monkeypatch.setattr(url_filter, "TOLERANCE", 0.5)  # fewer rounds; hosts that are closer to their limit are left out below
    rng = random.Random(21)
    hosts = [f"h{i}.example" for i in range(30)] + ["bad.net", "worse.net", "good.fr.org", "fine.org"]
    rows, links, pages = [], [], {}
    for i in range(160):
        host = rng.choice(hosts)
        to = [rng.choice([*hosts, host, "nowhere.example"]) for _ in range(rng.choice([0, 1, 2, 5]))]
        rows.append((i, f"https://{host}/fr/{i}", "<p>" + " ".join(f'<a href="{rng.choice(["", "http:", "HTTPS:"])}//{t}/x">x</a>' for t in to)))
        links += [(host, t) for t in to if t != host]
        pages[host] = pages.get(host, 0) + 1
    blocked = {h: n for h, n in pages.items() if h.endswith(".net")}
    allowed = {h: n for h, n in pages.items() if h.endswith(".org")}
    trust, distrust = ranks_of(links, allowed), ranks_of([(b, a) for a, b in links], blocked)
    limit = {h: max(trust.get(h, 0), pages[h] * 0.5 * 0.15) for h in pages}
    close = {h for h in pages if abs(distrust.get(h, 0) - limit[h]) < 0.08}
    bad = {h for h in pages if distrust.get(h, 0) > limit[h]}
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    host_of = {i: u.split("/")[2] for i, u, _ in rows}
    expected = {i: "block" if h.endswith(".net") else "allow" if h.endswith(".org") else "block" if h in bad else "allow" for i, h in host_of.items()}
    assert {i: v for i, v in found.items() if host_of[i] not in close} == {i: v for i, v in expected.items() if host_of[i] not in close}
    assert {h for h in bad - close if h.endswith(".example")} and {h for h in pages if h.endswith(".example")} - bad - close
