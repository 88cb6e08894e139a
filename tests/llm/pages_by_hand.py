"""Pages written by hand, with the blocks of their articles. Training never sees them."""

from __future__ import annotations

S1 = "The river rises in the hills north of the town and runs for some forty miles before it meets the sea."
S2 = "In the spring of that year the water stood higher than anyone could remember, and the lower fields were lost."
S3 = "Most of the mills along its banks have long since closed, though two of them are open to visitors in summer."
S4 = "Nobody quite agreed on what should be done about the bridge, so for years nothing was done at all."
P1, P2, P3, P4 = f"{S1} {S2} {S3}", f"{S2} {S4} {S1}", f"{S3} {S1} {S4}", f"{S4} {S3} {S2}"
LINKS = 'See <a href="/a">the long guide to rivers of the north</a> and <a href="/b">the second guide, for the south</a>.'
LINKS_TEXT = "See the long guide to rivers of the north and the second guide, for the south."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
FOOT = '<footer><p>&copy; 2024 River News</p><ul><li><a href="/privacy">Privacy</a></li></ul></footer>'
MENU = '<div class="topbar"><a href="/">Home</a> <a href="/x">Shop</a> <a href="/y">Sign in</a></div>'


def p(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


PAGES = {
    "links in front": (f"<html><body>{NAV}<article><h1>Rivers</h1><p>{LINKS}</p>{p(P1, P2)}</article>{FOOT}</body></html>", ["Rivers", LINKS_TEXT, P1, P2]),
    "links between, plain": (f'<html><body>{MENU}<div class="z1">{p(P1, P2)}<p>{LINKS}</p>{p(P3, P4)}</div>{FOOT}</body></html>', [P1, P2, LINKS_TEXT, P3, P4]),
    "sources at the end": (
        f'<html><body>{NAV}<article><h1>Rivers</h1>{p(P1, P2, P3)}<h2>Sources</h2><ul><li><a href="/s1">River atlas, 2001</a></li><li><a href="/s2">The mills of the valley, a survey</a></li><li><a href="/s3">Floods and how to live with them</a></li></ul></article>{FOOT}</body></html>',
        ["Rivers", P1, P2, P3, "Sources", "River atlas, 2001", "The mills of the valley, a survey", "Floods and how to live with them"],
    ),
    "question and answer": (
        f'<html><body><div class="header"><a href="/">Ask a river</a></div><div class="question"><h2>Why does the river flood?</h2>{p(P1)}</div><div class="answer">{p(P2, P3)}</div>{FOOT}</body></html>',
        ["Why does the river flood?", P1, P2, P3],
    ),
    "two plain parts": (f"<html><body>{MENU}<div><h2>Upper river</h2>{p(P1, P2)}</div><div><h2>Lower river</h2>{p(P3, P4)}</div>{FOOT}</body></html>", ["Upper river", P1, P2, "Lower river", P3, P4]),
    "byline in a header": (
        f'<html><body>{NAV}<article><header><h1>Rivers</h1><p class="byline">By Ann Lee, 2 May</p></header>{p(P1, P2)}</article>{FOOT}</body></html>',
        ["Rivers", "By Ann Lee, 2 May", P1, P2],
    ),
    "pull quote": (f'<html><body>{NAV}<article><h1>Rivers</h1>{p(P1)}<aside class="pullquote"><p>{S4}</p></aside>{p(P2, P3)}</article>{FOOT}</body></html>', ["Rivers", P1, S4, P2, P3]),
    "sections": (
        f"<html><body>{NAV}<main><h1>Rivers</h1><section><h2>Source</h2>{p(P1)}</section><section><h2>Mouth</h2>{p(P2, P3)}</section></main>{FOOT}</body></html>",
        ["Rivers", "Source", P1, "Mouth", P2, P3],
    ),
    "wiki": (
        f'<html><body><div id="mw-head"><ul><li><a href="/t">Talk</a></li><li><a href="/e">Edit</a></li></ul></div><div id="content"><h1>River</h1><div id="bodyContent"><p>The <a href="/r">river</a> is a <a href="/t">tributary</a> of the <a href="/g">Great River</a>. {S1}</p>'
        f'<h2>Course</h2><p>It passes <a href="/1">Upton</a>, <a href="/2">Middleton</a> and <a href="/3">Downton</a>. {S2}</p><h2>References</h2><ol><li><a href="/q">Smith</a>, The river, 1990, p. 12.</li><li><a href="/w">Jones</a>, Floods, 2003, p. 7.</li></ol></div></div>{FOOT}</body></html>',
        ["River", f"The river is a tributary of the Great River. {S1}", "Course", f"It passes Upton, Middleton and Downton. {S2}", "References", "Smith, The river, 1990, p. 12.", "Jones, Floods, 2003, p. 7."],
    ),
    "old tables": (
        f'<html><body><table><tr><td><a href="/">Home</a><br><a href="/l">Links</a></td><td><h1>My river</h1>{p(P1, P2)}</td></tr></table></body></html>',
        ["My river", P1, P2],
    ),
    "definition list": (f"<html><body>{NAV}<article><h1>Terms</h1>{p(P1)}<dl><dt>Weir</dt><dd>{S3}</dd><dt>Ford</dt><dd>{S4}</dd></dl>{p(P2)}</article>{FOOT}</body></html>", ["Terms", P1, "Weir", S3, "Ford", S4, P2]),
    "figure": (
        f'<html><body>{NAV}<article><h1>Rivers</h1>{p(P1)}<figure><img src="r.jpg"><figcaption>The river in May, seen from the old bridge.</figcaption></figure>{p(P2)}</article>{FOOT}</body></html>',
        ["Rivers", P1, "The river in May, seen from the old bridge.", P2],
    ),
    "recipe": (
        f"<html><body>{NAV}<div class='recipe'><h1>River trout</h1>{p(S1)}<h2>Ingredients</h2><ul><li>2 trout</li><li>50 g butter</li><li>1 lemon</li></ul><h2>Method</h2><ol><li>{S2}</li><li>{S3}</li></ol></div>{FOOT}</body></html>",
        ["River trout", S1, "Ingredients", "2 trout", "50 g butter", "1 lemon", "Method", S2, S3],
    ),
    "code": (f"<html><body>{NAV}<article><h1>Reading gauges</h1>{p(P1)}<pre><code>level = read(gauge)\nprint(level)</code></pre>{p(P2)}</article>{FOOT}</body></html>", ["Reading gauges", P1, "level = read(gauge) print(level)", P2]),
    "data table": (
        f"<html><body>{NAV}<article><h1>Levels</h1>{p(P1)}<table><tr><th>Year</th><th>Metres</th></tr><tr><td>1990</td><td>3.1</td></tr><tr><td>1991</td><td>2.8</td></tr></table>{p(P2)}</article>{FOOT}</body></html>",
        ["Levels", P1, "Year", "Metres", "1990", "3.1", "1991", "2.8", P2],
    ),
    "comments and related": (
        f'<html><body>{NAV}<article><h1>Rivers</h1>{p(P1, P2)}</article><div class="related"><h3>Related</h3><ul><li><a href="/1">More on lakes</a></li><li><a href="/2">More on ponds</a></li></ul></div>'
        f'<section id="comments"><h3>2 comments</h3><div class="comment"><p>{S3}</p></div><div class="comment"><p>Thanks for this.</p></div></section>{FOOT}</body></html>',
        ["Rivers", P1, P2],
    ),
    "cookies, advert, newsletter": (
        f'<html><body><div class="cookie-banner"><p>We use cookies to improve your visit. By going on you agree to our use of them on this site and others.</p><button>OK</button></div>{NAV}<article><h1>Rivers</h1>{p(P1)}<div class="advert"><p>Buy a boat today and save on your second one.</p></div>{p(P2)}'
        f'<div class="newsletter"><p>Sign up for our weekly letter.</p><form><input name="mail"><button>Go</button></form></div></article>{FOOT}</body></html>',
        ["Rivers", P1, P2],
    ),
    "sidebar": (f'<html><body>{NAV}<div class="wrap"><div class="content"><h1>Rivers</h1>{p(P1, P2, P3)}</div><div class="sidebar"><h3>Archive</h3><ul><li><a href="/1">January</a></li><li><a href="/2">February</a></li></ul><p>About this site.</p></div></div>{FOOT}</body></html>', ["Rivers", P1, P2, P3]),
    "nested plain wrappers": (f'<html><body>{MENU}<div class="a"><div class="b"><div class="c"><h1>Rivers</h1>{p(P1, P2)}</div></div></div>{FOOT}</body></html>', ["Rivers", P1, P2]),
    "lead and body": (f'<html><body>{NAV}<div class="story"><h1>Rivers</h1><p class="lead">{S4}</p><div class="story-body">{p(P1, P2)}</div></div>{FOOT}</body></html>', ["Rivers", S4, P1, P2]),
    "interview": (
        f"<html><body>{NAV}<article><h1>A talk by the river</h1><p><b>When did you come here?</b></p>{p(P1)}<p><b>And why?</b></p>{p(P2)}</article>{FOOT}</body></html>",
        ["A talk by the river", "When did you come here?", P1, "And why?", P2],
    ),
    "list of steps": (f"<html><body>{NAV}<article><h1>How to cross</h1><ol><li>{S1}</li><li>{S2}</li><li>{S3}</li></ol></article>{FOOT}</body></html>", ["How to cross", S1, S2, S3]),
    "three answers": (
        f'<html><body>{NAV}<main><div class="question"><h1>How deep is it?</h1>{p(S1)}</div><div class="answers"><div class="answer">{p(P1)}</div><div class="answer">{p(P2)}</div><div class="answer">{p(P3)}</div></div></main>{FOOT}</body></html>',
        ["How deep is it?", S1, P1, P2, P3],
    ),
    "further reading": (
        f'<html><body>{NAV}<article><h1>Rivers</h1>{p(P1, P2, P3)}<p>Further reading: <a href="/1">Mills</a>, <a href="/2">Bridges of the valley</a>, <a href="/3">The flood of 1953</a>.</p></article>{FOOT}</body></html>',
        ["Rivers", P1, P2, P3, "Further reading: Mills, Bridges of the valley, The flood of 1953."],
    ),
    "bare text": (f"<html><body><h1>Rivers</h1>{P1}<br><br>{P2}</body></html>", ["Rivers", f"{P1} {P2}"]),
    "date line": (f'<html><body>{NAV}<article><h1>Rivers</h1><div class="meta">2 May 2024</div>{p(P1, P2)}</article>{FOOT}</body></html>', ["Rivers", "2 May 2024", P1, P2]),
    "notes": (
        f'<html><body>{MENU}<div class="page"><h1>Rivers</h1>{p(P1, P2)}<h3>Notes</h3><ol><li>Levels are given in metres.</li><li>See also <a href="/n">the gauge at Upton</a>.</li></ol></div>{FOOT}</body></html>',
        ["Rivers", P1, P2, "Notes", "Levels are given in metres.", "See also the gauge at Upton."],
    ),
}
