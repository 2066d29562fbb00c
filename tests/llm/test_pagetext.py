"""Page text: asides that hold half of a page, hosts of any size, and a plain scorer and voter over well-formed pages."""

import random
import xml.etree.ElementTree as ET
from collections import Counter, defaultdict

import pytest

from talkloom.llm import pagetext

SCHEMA = "page_id long, url string, html string"


def prose(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(n))


def texts(spark, rows):
    return {r.page_id: r.text for r in pagetext.op4(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("name", ["sidebar", "promo-box", "x-columns"])
@pytest.mark.parametrize("same", [True, False])
def test_large_asides_on_hosts_of_any_size(spark, name, same):
    r = random.Random(7)
    rows, want = [], {}
    fixed = prose(r, 260)
    for host, n in (("lone", 1), ("two", 2), ("five", 5), ("fifty", 50)):
        for i in range(n):
            head, parts = prose(r, 5), [prose(r, 50) for _ in range(5)]
            aside = fixed if same else prose(r, 260)
            body = f"<div id=content><h1>{head}</h1>{''.join(f'<p>{p}</p>' for p in parts)}</div><div class='{name}'><p>{aside}</p></div>"
            rows.append((len(rows), f"https://{host}.example/{i}", f"<html><body>{body}</body></html>"))
            want[rows[-1][0]] = " ".join([head, *parts])
            if name == "x-columns" and not (same and n > 2):
                want.pop(rows[-1][0])  # neither a name nor repeats tell
    got = texts(spark, rows)
    assert {k: got[k] for k in want} == want


def test_named_wrappers_of_whole_articles(spark):
    r = random.Random(8)
    parts = [prose(r, 60) for _ in range(4)]
    inner = "".join(f"<p>{p}</p>" for p in parts)
    rows = [(0, "https://a.example/0", f"<body><div class=widget>{inner}</div></body>"), (1, "https://b.example/0", f"<body><div>Menu</div><div class=sidebar>{inner}</div></body>"), (2, "https://c.example/0", f"<body><div class=comments>{inner}</div></body>")]
    got = texts(spark, rows)
    assert all(" ".join(parts) in got[i] for i in range(3))


def plain(rows):
    """Every container's score from a tree, summed by host and path; text at the winning path, or at the page's own best."""
    pages, votes, depth_of = [], defaultdict(Counter), {}
    for name, url, html in rows:
        tree = ET.fromstring(html)
        found = []

        def walk(e, path, depth, link, found=found):
            link = link or e.tag == "a"
            held = e.tag in ("html", "body", "div")
            path = path + (".".join([e.tag, *sorted(e.get("class", "").split())]),) if held else path
            good = every = 0
            for t in [e.text, *[c.tail for c in e]]:
                size = len(" ".join((t or "").split()))
                every, good = every + size, good + (0 if link else size)
            at = len(found)
            if held:
                found.append(None)
            for c in e:
                g, n = walk(c, path, depth + 1, link)
                good, every = good + g, every + n
            if held:
                found[at] = (path, depth, good, every, e)
            return good, every

        total, _ = walk(tree, (), 1, False)
        scored = [(int(2000 * (g / n) * (g / total) / (g / n + g / total)), d, p, e) for p, d, g, n, e in found if g]
        host = url.split("/")[2]
        for score, d, p, _ in scored:
            votes[host][p] += score
            depth_of[host, p] = max(d, depth_of.get((host, p), 0))
        pages.append((name, host, scored))
    out = {}
    for name, host, scored in pages:
        win = max(votes[host], key=lambda p: (votes[host][p], depth_of[host, p]))
        chosen = [e for _, _, p, e in scored if p == win] or [max(scored, key=lambda s: (s[0], s[1]))[3]]
        out[name] = " ".join(" ".join("".join(b.itertext()).split()) for c in chosen for b in c.iter() if b.tag in ("p", "li") and "".join(b.itertext()).split())
    return out


def test_scores_and_votes_against_a_plain_version(spark):
    r = random.Random(9)
    rows = []
    for h in range(6):
        for i in range(r.randint(1, 7)):
            links = "".join(f"<li><a>{prose(r, r.randint(1, 4))}</a></li>" for _ in range(r.randint(1, 9)))
            blocks = [f"<div class='list'>{links}</div>", *[f"<div class='part'><p>{prose(r, r.randint(1, 30))}</p></div>" for _ in range(r.randint(0, 3))]]
            main = f"<div class='main one'><div class='inner'>{''.join(f'<p>{prose(r, r.randint(5, 60))}</p>' for _ in range(r.randint(1, 6)))}</div><div class='more'><p>{prose(r, 3)}</p></div></div>"
            blocks.insert(r.randint(0, len(blocks)), main)
            rows.append((len(rows), f"https://h{h}.example/{i}", f"<html><body>{''.join(blocks)}</body></html>"))
    assert texts(spark, rows) == plain(rows)
