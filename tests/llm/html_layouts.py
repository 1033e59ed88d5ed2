"""Pages written by hand, unlike those the trees learn from: their stories, and the layouts around them."""

from __future__ import annotations

STORIES = [
    [
        ("h1", "How the old mill was saved"),
        ("p", "For nearly forty years the mill by the river stood empty, and most people in the village had stopped looking at it."),
        ("p", "Then, in the spring of last year, a group of neighbours met in the school hall. They had a plan, a small budget and a borrowed ladder."),
        ("h2", "A slow start"),
        ("p", "The first months went badly. The roof leaked, the wheel would not turn, and two of the beams had to be replaced."),
        ("p", "Today the mill grinds flour again on Saturdays, and visitors can watch from the bridge."),
    ],
    [
        ("h1", "Notes on growing tomatoes indoors"),
        ("p", "Tomatoes need light more than warmth. A window that faces south is best, but a cheap lamp does nearly as well if it burns for fourteen hours."),
        ("p", "Water them when the top of the soil is dry; once a day is too often for most pots."),
        ("p", "Shake the flowers gently every morning, since there are no bees in the kitchen to do it. After six weeks or so the first fruits turn red."),
    ],
]
STORY = "{story}"
FOOT = "<footer><p>Copyright 2021 The Village Paper. All rights reserved.</p></footer>"
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li><li><a href="/contact">Contact</a></li></ul>'
LAYOUTS = {
    "bare body": STORY,
    "body with nav": f"<nav>{MENU}</nav>{STORY}{FOOT}",
    "body with plain menu": f"{MENU}{STORY}<footer>Copyright 2021 The Village Paper</footer>",
    "plain div": f"<div>{STORY}</div>",
    "div post": f'<header><a href="/">The Village Paper</a></header><div class="post">{STORY}</div>{FOOT}',
    "div id c": f'<div id="nav">{MENU}</div><div id="c">{STORY}</div><div id="footer">Copyright 2021, all rights reserved</div>',
    "nested divs": f'<div id="page"><div id="top"><nav>{MENU}</nav></div><div class="row"><div class="col-8">{STORY}</div></div></div>{FOOT}',
    "side by side": f'<div class="container"><div class="left">{STORY}</div><div class="sidebar"><h3>Most read</h3>{MENU}</div></div>{FOOT}',
    "aside first": f"<aside><h3>Related</h3>{MENU}</aside><section>{STORY}</section>{FOOT}",
    "table layout": f"<table><tr><td>{MENU}</td><td>{STORY}</td></tr></table>",
    "one cell": f"<center><table><tr><td>{STORY}</td></tr></table></center>",
    "custom elements": f"<site-nav>{MENU}</site-nav><app-content>{STORY}</app-content><cookie-banner>We use cookies to make this site better. <button>OK</button></cookie-banner>",
    "main": f'<header><h2>The Village Paper</h2><nav>{MENU}</nav></header><main id="m">{STORY}</main>{FOOT}',
    "article with share links": f'<article>{STORY}<div class="share"><a href="#">Tweet</a> <a href="#">Mail</a></div></article>{FOOT}',
    "comments": f'<div class="entry">{STORY}</div><div id="comments"><h3>2 comments</h3><p>I remember it well, thank you for writing.</p><p>Nonsense, all of it.</p></div>',
    "newsletter": f'<div class="text">{STORY}</div><div class="newsletter"><p>Sign up for our letter.</p><form><input name="mail"><button>Send</button></form></div>{FOOT}',
    "advert above": f'<div class="advert"><p>Buy two, get one for free. Only this week!</p></div><div class="body-text">{STORY}</div>',
    "forms and selects": f"<form action=/s><label>Search</label><input name=q><select><option>All<option>Some</select><button>Go</button></form><div>{STORY}</div>{FOOT}",
    "cookie notice first": f'<div class="cookie-consent"><p>This site uses cookies, as most sites do.</p><button>Fine</button></div><div class="wrap"><div class="inner">{STORY}</div></div>',
    "section of sections": f'<div role="navigation">{MENU}</div><section class="x"><section class="y">{STORY}</section></section><div role="contentinfo"><p>Copyright 2021 The Village Paper</p></div>',
}


def pages() -> list[tuple[str, str, str]]:
    """Name, html and main text of every page."""
    out = []
    for number, story in enumerate(STORIES):
        html = "\n".join(f"<{tag}>{text}</{tag}>" for tag, text in story)
        for name, layout in LAYOUTS.items():
            page = f"<html><head><title>{story[0][1]}</title></head><body>{layout.replace(STORY, html)}</body></html>"
            out.append((f"{name} {number}", page, "\n\n".join(text for _, text in story)))
    return out
