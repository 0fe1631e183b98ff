import html
import re

import duckdb
import numpy as np

from lattica.llm import html_extract as he


def plain(page):
    """The article's blocks of the synthetic pages, by plain rules."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
    body = re.sub(r"</?b>|<br>", " ", body[1] if body else "")
    parts = re.split(r"</?(?:p|h1|h2|div|li|ul)>", body)
    return "\n".join(t for p in parts if (t := " ".join(html.unescape(re.sub(r"<[^>]*>?", "", p)).split())))


def test_synthetic_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = he.report(pages).join(pages.select("page_id", "html"), "page_id").collect()
    wrong = [r for r in got if r.text != plain(r.html)]
    assert len(got) == 250 and not wrong, (wrong[0].text[:500], plain(wrong[0].html)[:500], wrong[0].html[:900])
    assert all(r.n_chars == len(r.text) for r in got)


def test_generated_layouts():
    model = he.fit()
    good = every = hit = 0
    for page in he.training_pages(60, seed=99):
        root = he.parse(page)
        nodes, x = he.features(root)
        kept = he.decode(nodes, model.odds(x))
        for node, text in he.blocks(root):
            good += (id(node) in kept) == bool(node.marked)
            every += 1
        for n in nodes:  # no content under boilerplate
            hit += n.parent is not None and id(n) in kept and id(n.parent) not in kept
    assert good / every > 0.93 and not hit


def test_cases(spark):
    page = '<body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>One  two\n three.<p>Caf&eacute; &lt;b&gt; and <i>more</i> text, with words enough to read.</p><form><p>Name</p></form></article><footer>&copy; me</footer>'
    rows = [(1, "u", None), (2, None, ""), (3, "u", page), (3, "u", page), (4, "u", "<p"), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "<script>if (a</b) x = '</p>'</script>")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = he.report(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 7 and by[1] == by[2] == by[4] == by[6] == ""
    assert by[3] == "A & B\nOne two three.\nCafé <b> and more text, with words enough to read."
    assert he.report(df.limit(0)).count() == 0


def test_many_siblings():
    text = "Some words of a long article, which goes on for a while and tells of this and that."
    paragraphs = [f"Paragraph {i}. {text}" for i in range(300)]
    links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(300))
    page = f"<body><div class='menu'><ul>{links}</ul></div><article><h1>Title of it</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}</article><footer>&copy; me</footer></body>"
    root = he.parse(page)
    nodes, x = he.features(root)
    letters = lambda n: n.letters + sum(map(letters, n.kids))
    at = x.shape[1] - 14
    for n, row in zip(nodes, x, strict=True):
        own = n.parent.kids if n.parent else [n]
        assert row[at + 6] == sum(k.tag == n.tag for k in own)
        assert abs(row[at + 7] - np.log1p(sum(map(letters, own)) / len(own))) < 1e-9
    assert he.main_text(root, nodes, he.fit().odds(x)) == "\n".join(["Title of it", *paragraphs])


def test_left_out_elements_without_end_tag():
    texts = lambda page: [t for _, t in he.blocks(he.parse(page))]
    article = "<article><p>One.</p><p>Two.</p></article>"
    for tag in sorted(he.RAW - he.TEXT):
        assert texts(f"<div><{tag} class=x></div>{article}") == ["One.", "Two."]
        assert texts(f"<div><{tag}></div>{article}<{tag}>no</{tag}><p>Three.</p>") == ["One.", "Two.", "Three."]
        assert texts(f"<{tag}>no<{tag}>no</{tag}>no</{tag}>{article}<{tag}>no</{tag} >") == ["One.", "Two."]
    for tag in sorted(he.TEXT):
        assert texts(f"{article}<{tag}><p>no</p>") == ["One.", "Two."]
    assert texts(f"<script>a = '<button>'</script><button><button>no</button>{article}<script>b = '</button>'</script>") == ["One.", "Two."]
    assert texts("<button>" * 20_000 + article) == ["One.", "Two."]
