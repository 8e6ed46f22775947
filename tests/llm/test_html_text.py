import pytest

from paperloom.llm.html_text import extract_text, render


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>one<p>two", "one\n\ntwo"),
        ("<h1>A <b>b</b></h1>loose", "A b\n\nloose"),
        ("<ul><li>a<li>b<ol><li>c<li>d</ol></ul>", "- a\n- b\n  1. c\n  2. d"),
        ("<table><tr><th>Name<th>Qty<tr><td>Apple<td>3</table>", "Name  | Qty\nApple | 3"),
        ("<table><tr><td colspan=2>wide<td>x<tr><td>a<td>b<td>c</table>", "wide |   | x\na    | b | c"),
        ("<p>x</p><div style='display: none'>no</div><span hidden>no</span><script>if (a<b) no</script>y", "x\n\ny"),
        ("<head><title>t</title></head><body>&lt;a&gt; &amp; b", "<a> & b"),
        ("a<br>b<br/>c", "a\nb\nc"),
        ("<pre>  a\n   b</pre>", "  a\n   b"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("</p></div>x</td>", "x"),
        ("<div>a</div> <div>b</div>", "a\nb"),
        ("a <b> b</b>c", "a bc"),
        ("<![if x]>a<!-- no -->b", "ab"),
        ("", ""),
        (None, ""),
    ],
)
def test_render(html, text):
    assert render(html) == text


def test_deep_and_long():
    assert render("<div>" * 30000 + "x") == "x"
    assert render("<ul>" * 500 + "<li>x").strip() == "- x"
    assert len(render("<td>" + "word " * 100000)) == 499999


def test_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", "t"), (1, "<p>a", "t"), (None, None, "u"), (2, "", "u")], "page_id long, html string, text string")
    assert sorted((str(r.page_id), r.text) for r in extract_text(df).collect()) == [("1", "a"), ("1", "a"), ("2", ""), ("None", "")]
    assert extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds", "so x=1 holds"),
        ("<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow><annotation encoding='application/x-tex'>E=mc^2</annotation><annotation-xml><ci>no</ci></annotation-xml></semantics></math>", "E=mc2"),
        ("a<math display=block><mfrac><mn>1</mn><mn>2</mn></mfrac><mphantom><mi>no</mi></mphantom></math>b", "a\n1 2\nb"),
        ("<math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>0</mn></mtd></mtr><mtr><mtd><mn>0</mn></mtd><mtd><mspace/><mn>1</mn></mtd></mtr></mtable></math>", "1 0\n0 1"),
        ("<math><mi>x</mi><mtext>for <b>all</b> y</mtext></math>", "xfor all y"),
        ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><style>no</style>no<rect/><text x=1>Left</text><g><text>Ri<tspan>ght</tspan></text></g></svg>", "Left\nRight"),
        ("<svg><text><tspan x=0>one</tspan><tspan x=0 dy=1em>two</tspan></text></svg>", "one\ntwo"),
        ("<div>x<svg><switch><foreignObject><p>a<p>b</foreignObject><text>no</text></switch></svg>y</div>", "x\n\na\n\nb\n\ny"),
        ("<svg><text display=none>no</text><text visibility=hidden>no</text><text style='display:none'>no</text><text>yes</text></svg>", "yes"),
        ("<svg><path d='M0'/><text><![CDATA[a < b]]></text></svg><![CDATA[no]]>c", "a < b\nc"),
        ("<svg><path d='M0'><p>out", "out"),
        ("<p>a <svg width=1><path d='M0'/></svg>b</p>", "a b"),
        ("<table><tr><td><svg><text>k</text></svg><td><math><mn>7</mn></math></table>", "k | 7"),
        ("<ul><li>a<svg><foreignObject><ul><li>b</ul></foreignObject></svg></ul>", "- a\n  - b"),
        ("<svg/>a<math/>b", "ab"),
    ],
)
def test_formulas_and_drawings(html, text):
    assert render(html) == text


def test_deep_drawings():
    assert render("<svg>" + "<g>" * 30000 + "<text>x") == "x"
    assert render("<svg><path>" * 20000 + "<p>x") == "x"
    assert render("<math>" + "<mrow>" * 30000 + "<mi>x") == "x"


def test_odd_attributes_and_spans():
    for start in ("--5", "²", "9" * 5000, "", " 7x", "+3", "-2"):
        assert "x" in render(f'<ol start="{start}"><li>x</ol>')
    assert render('<ol start=" 7x"><li>a<li>b</ol>') == "7. a\n8. b"
    for span in ("²", "9" * 5000, "-1", "0", "1000", "x"):
        for name in ("colspan", "rowspan"):
            assert render(f'<table><tr><td {name}="{span}">a<td>b<tr><td>c<td>d</table>').split() != []
    assert render("<table><tr><td rowspan=2>A<td>B<tr><td>C<td>D</table>") == "A | B\n  | C | D"
    assert render("<table><tr><td rowspan=0>A<td>B<tr><td>C</table>") == "A | B\n  | C"
    assert render("<table><tr><td colspan=1000>title<tr><td>a<td>b</table>") == "title |\na     | b"
    assert render("<table><tr><td>日本<td>x<tr><td>abcd<td>y</table>") == "日本 | x\nabcd | y"
    long = " ".join(["word"] * 100)
    lines = render(f"<table><tr><td>{long}<td>end<tr><td>a<td>b</table>").split("\n")
    assert " ".join(lines).split().count("word") == 100 and {x.index("|") for x in lines if "|" in x} == {lines[0].index("|")}


def test_visibility():
    assert render("<details><summary>s</summary>body</details>") == "s" and render("<details open><summary>s</summary>body</details>") == "s\nbody"
    assert render("<dialog>x</dialog>y") == "y" and "x" in render("<dialog open>x</dialog>y")
    assert render('<div style="visibility:hidden">a<span style="visibility: visible">b</span>c</div>') == "b"
    assert render('<div hidden>a</div><div hidden style="display:block">b</div>') == "b"
    assert render('<div style="display:none">a<span style="visibility:visible">b</span></div>c') == "c"
    assert render('<p style="no-display:none">a</p>') == "a"


def test_random_trees_show_each_visible_word_once_in_order():
    # trees of well-formed elements against what a plain walk says is visible
    import random

    rng = random.Random(4)
    boxes = ["div", "p", "span", "b", "section", "ul", "li", "table", "blockquote", "h2", "a"]
    for _ in range(300):
        words: list[str] = []

        def build(depth: int, shown: bool) -> str:
            out = []
            for _ in range(rng.randint(1, 3)):
                if depth == 0 or rng.random() < 0.4:
                    word = f"w{rng.randrange(10**9)}"
                    out.append(f" {word} ")
                    if shown:
                        words.append(word)
                    continue
                tag, hide = rng.choice(boxes), rng.random() < 0.2
                style = rng.choice([" hidden", ' style="display: none"', ' style="color:red;DISPLAY:none"']) if hide else ""
                if tag == "table":
                    out.append(f"<table{style}><tr><td>{build(depth - 1, shown and not hide)}</td></tr></table>")
                elif tag == "p":  # nothing that ends a paragraph in it
                    out.append(f"<p{style}>{build(0, shown and not hide)}</p>")
                elif tag == "li":
                    out.append(f"<ul{style}><li>{build(depth - 1, shown and not hide)}</li></ul>")
                else:
                    out.append(f"<{tag}{style}>{build(depth - 1, shown and not hide)}</{tag}>")
            return "".join(out)

        page = build(5, True)
        assert [w for w in render(page).replace("|", " ").split() if w.startswith("w")] == words, page


def test_broken_pages_never_fail():
    import random

    rng = random.Random(8)
    bits = ["<table>", "</table>", "<tr>", "<td rowspan=3>", "<td colspan='x'>", "</td>", "<ul>", "<li>", "</ul>", "<ol start='--5'>", "<p>", "</p>", "text ", "<svg><text>", "</svg>", "<math><mi>", "</math>", "<b", " a='", "'>", "<!--", "-->", "<![CDATA[", "]]>", "&amp;", "&#x110000;", "<pre>\n x", "</pre>", "<details>", "<summary>", "<select><option>", "<br/>", "</br>", "<foreignobject>", "\x00", "<script>", "</script>", "<dialog>", "<dd>", "<caption>", "<td rowspan=0>", "<th>"]
    for _ in range(10_000):
        assert isinstance(render("".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))), str)


BROKEN = ["<a ", '<a b="', "<!--", "</b ", "<?p ", "<!x ", "<![if x", "<b>", "<b><p>", "<li>", "<b><li>", "<td>", "<table><tr><td>", "<p><b>", "</p>", "<", "&", "&#", "<svg><text>", "<math><mi>", "<script></", "<a b='>", "<ul><li><b>"]


@pytest.mark.parametrize("piece", BROKEN)
def test_a_broken_page_takes_time_as_its_length(piece):
    import time

    for text in (piece * (1_000_000 // len(piece) if "table" not in piece else 2000), "x" + piece * (200_000 // len(piece) if "table" not in piece else 500) + "y>"):
        began = time.thread_time()
        render(text)
        assert time.thread_time() - began < 25


def test_wide_and_tall_cells_take_time_as_their_number():
    import time

    began = time.thread_time()
    render("<table>" + "<tr><td colspan=1000 rowspan=65534>x</td></tr>" * 1000 + "</table>")
    assert time.thread_time() - began < 5


def test_what_nothing_ends_is_text():
    cases = {'a <b>x</b> y <a href="q': 'a x y <a href="q', "x <!-- y <b>z</b>": "x <!-- y <b>z", "x <a <a <a": "x <a <a <a", "x < y <b>z": "x < y z", "x </b y": "x </b y", "x <!doc y": "x <!doc y", "x <?p y": "x <?p y", "x <a &amp; y": "x <a & y"}
    assert {h: render(h) for h in cases} == cases


def test_list_numbers_and_table_feet():
    assert render("<ol reversed><li>a<li>b<li>c</ol>") == "3. a\n2. b\n1. c"
    assert render("<ol start=5 reversed><li>a<li>b</ol>") == "5. a\n4. b"
    assert render("<ol><li>a<li value=7>b<li>c</ol>") == "1. a\n7. b\n8. c"
    assert render("<table><tfoot><tr><td>sum<td>3</tfoot><tbody><tr><td>a<td>1<tr><td>b<td>2</tbody></table>") == "a   | 1\nb   | 2\nsum | 3"
