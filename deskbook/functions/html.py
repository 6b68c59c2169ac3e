"""Tokens, attributes and fields of HTML pages as SQL text.

Patterns find tags and what a page says about itself; bodies are read from tag events (``operators.pages``). Functions take
and return SQL: these expressions are large, and one text is one call to build.
"""

from __future__ import annotations

from functools import reduce

#: Every character of a page belongs to one token: a comment, a script or style as a whole, a tag, or text between them.
TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<[!?][^>]*>"
    r"""|</?[a-z][^<>"']*(?:(?:"[^"<]*"|'[^'<]*')[^<>"']*){0,60}>|</?[a-z][^<>]*>|[^<]+|<"""
)
# What addresses of attachments contain.
ATTACHMENT = ("FileDownload", "servlet.shepherd", "download")
# Character references, the one that makes others last.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&#160;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&times;", "×"), ("&deg;", "°"), ("&euro;", "€"), ("&amp;", "&"),
)
#: Dates in running text: year first; two numbers and a year, month first unless it can't be one; months by name.
MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
DATE_FORMS = (
    (r"(?:^|[^0-9])(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[^0-9]|$)", "ymd"), (r"(?:^|[^0-9])(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:[^0-9]|$)", "mdy"),
    (r"(?:^|[^a-z])" + MONTH + r"\.? +(\d{1,2})(?:st|nd|rd|th)?,? +(\d{4})(?:[^0-9]|$)", "bdy"), (r"(?:^|[^0-9])(\d{1,2})(?:st|nd|rd|th)?[ -](?:of )?" + MONTH + r"\.?,?[ -](\d{4})(?:[^0-9]|$)", "dby"),
)
CLOCK, ZONE = r"(?:^|[^0-9:])(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)? *([ap])?", r"\d(?::\d{2})+(?:\.\d+)? *(?:[ap]\.?m\.?)? *(z|utc|gmt|[+-]\d{2}:?\d{2})(?:[^a-z0-9]|$)"
LABELLED = r"\s*[:-]?\s*([A-Za-z0-9,./: +-]{4,})"


def lit(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def listed(names) -> str:
    return ", ".join(map(lit, names))


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def replaced(x: str, steps) -> str:
    return reduce(lambda out, step: f"regexp_replace({out}, {lit(step[0])}, {lit(step[1])})", steps, x)


def compact(x: str) -> str:
    """White space of any script collapsed to single spaces, none at the ends."""
    return f"trim(regexp_replace({x}, {lit('(?U)' + chr(92) + 's+')}, ' '))"


def unescaped(x: str) -> str:
    """Character references as what they stand for, one after another."""
    step = "(out, e) -> replace(out, concat(substring_index(e, ';', 1), ';'), substring(e, instr(e, ';') + 1))"
    return f"if(contains({x}, '&'), aggregate(array({listed(r + to for r, to in ENTITIES)}), {x}, {step}), {x})"


def words(x: str) -> str:
    """A text between tags with its references resolved and single blanks."""
    return compact(unescaped(x))


def plain(x: str) -> str:
    """Text of a piece of HTML, tags as spaces."""
    return let("h_", f"regexp_replace({x}, {lit('(?s)<[^>]*>')}, ' ')", words("h_"))


def some(x: str) -> str:
    return let("s_", f"trim({x})", "if(s_ = '', null, s_)")


def element(name: str) -> str:
    return rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>"


def attribute(tag: str, name: str) -> str:
    """An attribute's value, quoted or not, empty if the tag has none."""
    value = f"regexp_extract({tag}, {lit(rf'(?is)\s{name}\s*=\s*(' + '"[^"]*"|' + r"'[^']*'" + r'|[^\s"' + "'" + r'>]+)')}, 1)"
    bare = "^[\"']|[\"']$"
    return f"if(contains(lower({tag}), {lit(name)}), {let('v_', f'regexp_replace({value}, {lit(bare)}, {lit("")})', unescaped('v_'))}, '')"


def meta(html: str, key: str, value: str) -> str:
    """Content of the first ``<meta>`` with an attribute, whichever comes first; null if it is empty or missing."""
    find = lambda pattern: some(let("m_", f"regexp_extract({html}, {lit(pattern)}, 1)", unescaped("m_")))
    return f"coalesce({find(rf'(?is)<meta\b[^>]*{key}="(?:{value})"[^>]*content="([^"]*)"')}, {find(rf'(?is)<meta\b[^>]*content="([^"]*)"[^>]*{key}="(?:{value})"')})"


def title(html: str) -> str:
    """The first h1, else og:title, else the title element, else the empty text."""
    first = lambda name: some(plain(f"regexp_extract({html}, {lit(element(name))}, 1)"))
    return f"coalesce({first('h1')}, {meta(html, 'property', 'og:title')}, {first('title')}, '')"


def date(x: str) -> str:
    """ISO form of the first date in a text, with the time and the zone's offset if it has them; null without a date.

    Forms with a name or the year in front are read before others; of two numbers the first is the month unless it is above
    12. Forms without a day and days that don't exist are no dates.
    """
    part = lambda pattern, k: f"regexp_extract(d_, {lit(pattern)}, {k})"
    month = lambda m: f"cast((instr('janfebmaraprmayjunjulaugsepoctnovdec', {m}) + 2) / 3 as int)"
    whens = []
    for pattern, form in DATE_FORMS:
        one, two, three = (part(pattern, k) for k in (1, 2, 3))
        order = {"ymd": (one, two, three), "bdy": (three, month(one), two), "dby": (three, month(two), one)}.get(form)
        made = f"concat_ws('-', {', '.join(order)})" if order else f"if(cast({one} as int) > 12, concat_ws('-', {three}, {two}, {one}), concat_ws('-', {three}, {one}, {two}))"
        whens.append((form, f"when d_ rlike {lit(pattern)} then {made}"))
    day = "case " + " ".join(w for _, w in sorted(whens, key=lambda w: ("ymd", "bdy", "dby", "mdy").index(w[0]))) + " end"
    hour = f"pmod(cast({part(CLOCK, 1)} as int), if({part(CLOCK, 4)} = '', 24, 12)) + if({part(CLOCK, 4)} = 'p', 12, 0)"
    clock = f"if(d_ rlike {lit(CLOCK)}, concat_ws(':', lpad({hour}, 2, '0'), {part(CLOCK, 2)}, lpad({part(CLOCK, 3)}, 2, '0')), '00:00:00')"
    zone = let("z_", part(ZONE, 1), "case when z_ = '' then '' when z_ in ('z', 'utc', 'gmt') then '+00:00' else concat(substring(z_, 1, 3), ':', right(z_, 2)) end")
    stamp = let("y_", f"try_to_timestamp({day}, 'yyyy-M-d')", f"if(y_ is null, null, concat(date_format(y_, 'yyyy-MM-dd'), 'T', {clock}, {zone}))")
    return let("d_", f"lower(regexp_replace({x}, '([0-9])T([0-9])', '$1 $2'))", stamp)


def dates(html: str) -> str:
    """``array(updated, published)``: of meta elements if there are any, else of a time element and labels in the text."""
    own = f"array({date(meta(html, 'property', 'article:modified_time|og:updated_time'))}, {date(meta(html, 'property', 'article:published_time|og:published_time'))})"
    extract = lambda pattern: f"regexp_extract({html}, {lit(pattern)}, 1)"
    time = f"coalesce({some(extract(r'(?is)<time\b[^>]*datetime="([^"]*)"'))}, {some(plain(extract(element('time'))))})"
    label = lambda word: f"regexp_extract(t_, {lit(word + LABELLED)}, 1)"
    told = let("t_", plain(html), f"transform(array({label('Updated')}, {label('Published')}, {time}), x_ -> {date('x_')})")
    return let("own_", own, f"if(own_[0] is not null or own_[1] is not null, own_, {let('told_', told, 'array(coalesce(told_[0], told_[2]), told_[1])')})")


def texts_of(html: str, pattern: str) -> str:
    """Non-empty texts of all matches."""
    return f"filter(transform(regexp_extract_all({html}, {lit(pattern)}, 0), e_ -> {plain('e_')}), t_ -> t_ <> '')"


def breadcrumbs(html: str) -> str:
    extract = lambda pattern, group: f"regexp_extract({html}, {lit(pattern)}, {group})"
    part = f"coalesce({some(extract(r'(?is)<nav\b[^>]*aria-label="[^"]*breadcrumb[^"]*"[^>]*>(.*?)</nav\s*>', 1))}, {extract(r'(?is)<(?:ul|ol|div)\b[^>]*class="[^"]*breadcrumbs?\b[^"]*"[^>]*>(.*?)</(?:ul|ol|div)\s*>', 1)})"
    items = let("i_", texts_of("p_", element("li")), f"if(size(i_) > 0, i_, {texts_of('p_', element('a'))})")
    return f"filter({let('p_', part, items)}, t_ -> lower(t_) <> 'home')"


def tags(html: str) -> str:
    full = lambda x: f"array_distinct(filter({x}, t_ -> t_ <> ''))"
    own = f"transform(regexp_extract_all({html}, {lit(r'(?is)<meta\b[^>]*property="article:tag"[^>]*content="([^"]*)"')}, 1), t_ -> trim({unescaped('t_')}))"
    keywords = f"transform(split(coalesce({meta(html, 'name', 'keywords')}, ''), ','), t_ -> trim(t_))"
    box = f"regexp_extract({html}, {lit(r'(?is)<(?:ul|div)\b[^>]*class="(?:[^"]* )?(?:tags|article-tags|topic-tags)(?: [^"]*)?"[^>]*>(.*?)</(?:ul|div)\s*>')}, 1)"
    return let("own_", full(own), f"if(size(own_) > 0, own_, {let('w_', full(keywords), f'if(size(w_) > 0, w_, {full(texts_of(box, element("a")))})')})")


def resolved(href: str, base: str) -> str:
    """An address against its page's."""
    bare = f"regexp_replace({base}, {lit('[?#].*$')}, '')"
    folder = f"regexp_replace({bare}, {lit('([^/:])/[^/]*$')}, '$1')"
    return (
        f"case when {href} rlike '^[A-Za-z][A-Za-z0-9+.-]*:' then {href} when startswith({href}, '//') then concat(regexp_extract({base}, '^([^:]*:)', 1), {href})"
        f" when startswith({href}, '/') then concat(regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1), {href}) when startswith({href}, '#') or startswith({href}, '?') then concat({bare}, {href}) else concat({folder}, '/', {href}) end"
    )
