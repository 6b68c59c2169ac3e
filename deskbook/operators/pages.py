"""Article bodies of HTML pages, from tables of tag events.

A page becomes a row for each tag and each text between tags. Tags are matched by running sums: an element's end is the next
event of its name at its depth, so elements nested in others of the same name end where they should, and unclosed ones
harm no other name. Scores of body candidates are differences of running sums; the best one's events are turned into
Markdown from the inside out, cells into rows, rows into tables, tables, callouts and quotes into the body.

All steps are windows over one page's events and one group-by; pages are shuffled once, by a digest of the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H

# What holds bodies by default, what holds them otherwise, and what is no part of them.
BODIES, BODY_CLASSES = ("article",), ("forceCommunityArticleDetail", "slds-rich-text-editor__output", "knowledgeArticle")
FALLBACK = ("article", "main", "section", "div")
REMOVED = ("script", "style", "template", "noscript", "nav", "header", "footer", "aside")
REMOVED_CLASSES = ("slds-breadcrumb", "breadcrumbs", "helpful", "feedback", "survey", "related", "article-related", "vote")
WARNED = "(?:note|tip|warning|important):"
CALLOUT = ("note", "tip", "warning", "important", "alert")
# Elements without an end, elements that hold others, and those that stand on lines of their own.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
HOLDERS = ("html", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "td", "blockquote", "details", "figure")
BLOCKS = (*HOLDERS, "p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "dl", "dt", "dd", "tr", "th", "hr", "figcaption", "address")
LEVELS = {"h1": 2, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}

#: Stand-ins inside Markdown until blanks are tidied: an indent, a blank and a line end of code; and what begins links,
#: their labels, parts, rows and cells.
MARKS = INDENT, BLANK, LINE, LINK, LABEL, PART, ROW, CELL = tuple(map(chr, range(1, 9)))


def has_class(names) -> str:
    return f"arrays_overlap(split(classes, '\\\\s+'), array({H.listed(names)}))" if names else "false"


def having(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with columns of SQL text."""
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def one_of(names) -> str:
    return f"name in ({H.listed(names)})" if names else "false"


def tag_events(pages: DataFrame, body_classes=BODY_CLASSES) -> DataFrame:
    """One row an event of ``pages`` (``r, page_id, url, title, html``), in order of ``i``.

    ``kind`` is 1 for an opening tag, -1 for a closing one, 2 for one without an end, 0 for text and the rest; ``text`` is
    a text's words with single blanks, ``raw`` as it was. ``titled`` is, for elements that could be bodies, the number of
    characters from their start to the end of the title's next occurrence in the page's text.
    """
    split = pages.select("r", "page_id", "url", F.lower("title").alias("title"), F.regexp_extract_all("html", F.lit(H.TOKEN), F.lit(0)).alias("tokens"))
    split = having(split, texts=f"transform(tokens, t -> if(startswith(t, '<') and t <> '<', '', {H.words('t')}))")
    could = H.lit(rf"(?i)^<(?:{'|'.join(FALLBACK)})\b|^<.*(?:{'|'.join((*body_classes, 'data-aura-class'))})")
    titled = f"if(title <> '' and p.tokens rlike {could}, nullif(instr(lower(array_join(filter(slice(texts, k + 1, size(texts)), t -> t <> ''), ' ')), title), 0) + length(title) - 1, null)"
    rows = split.select("r", "page_id", "url", F.expr(f"posexplode(transform(arrays_zip(tokens, texts), (p, k) -> struct(p.tokens as t, p.texts as text, {titled} as titled)))").alias("i", "e")).select("r", "page_id", "url", "i", "e.*")
    rows = having(rows, name="lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9:-]*)', 1))")
    rows = having(rows, name="if(name in ('', 'script', 'style'), null, name)")
    rows = having(rows, kind=f"case when name is null then 0 when startswith(t, '</') then -1 when {one_of(VOID)} then 2 else 1 end")
    attribute = lambda name: f"if(kind > 0, {H.attribute('t', name)}, '')"
    hidden = f"lower({attribute('aria-hidden')}) = 'true' or contains(lower(replace({attribute('style')}, ' ', '')), 'display:none')"
    picture = f"if(name = 'img', concat('![', {attribute('alt')}, '](', {attribute('src')}, ')'), null)"
    return rows.selectExpr(
        "r", "page_id", "url", "i", "name", "kind", "text", "if(startswith(t, '<') and t <> '<', null, t) as raw", "titled", f"{picture} as picture", f"{attribute('class')} as classes", f"contains({attribute('data-aura-class')}, 'knowledge') as known",
        f"{hidden} as hidden", f"if(name = 'a', {attribute('href')}, null) as href",
    )


def matched(events: DataFrame, bodies=BODIES, body_classes=BODY_CLASSES) -> DataFrame:
    """Events with running sums, and the sums at an element's other tag: ``end`` of opening ones, ``start`` of closing ones.

    Opening and closing tags of a name take turns at each depth, whatever its sign, so a stray closing tag or an unclosed
    element has no partner (null) and costs no other its own. ``named`` marks elements that are asked for as bodies,
    ``any`` pages that have one, ``all`` has a page's sums.
    """
    far, page = "over (partition by r order by i rows unbounded preceding)", "over (partition by r order by i rows between unbounded preceding and unbounded following)"
    counts = {"length": "if(text <> '', length(text) + 1, 0)", "headings": "if(kind = 1 and name in ('h2', 'h3', 'h4'), 1, 0)", "lists": "if(kind = 1 and name in ('ul', 'ol'), 1, 0)"}
    rows = having(events, named=f"kind = 1 and ({one_of(bodies)} or {has_class(body_classes)} or known)")
    rows = having(
        rows, **{c: f"sum({x}) {far}" for c, x in counts.items()}, all=f"struct(max(i) {page} + 1 as i, {', '.join(f'sum({x}) {page} as {c}' for c, x in counts.items())})", any=f"max(named) {page}",
        related=f"count_if(contains(lower(text), 'related')) {far}", warned=f"count_if(lower(text) rlike '{WARNED}') {far}", block=f"count_if({one_of(BLOCKS)}) {far}",
        in_link=f"coalesce(last(if(name = 'a' and kind <> 0, kind, null), true) {far} = 1, false)",
    )
    rows = having(rows, linked=f"sum(if(in_link, length(text), 0)) {far}", level="sum(if(abs(kind) = 1, kind, 0)) over (partition by r, name order by i rows unbounded preceding) + if(kind = -1, 1, 0)")
    figures = "(if(abs(kind) = 1, struct(kind, i, length, headings, lists, related, warned, block, linked, href, classes), null)) over (partition by r, name, level order by i)"
    rows = having(rows, next=f"lead{figures}", last=f"lag{figures}")
    return having(rows, end="if(kind = 1 and next.kind = -1, next, null)", start="if(kind = -1 and last.kind = 1, last, null)").drop("level", "next", "last")


def scored(events: DataFrame) -> DataFrame:
    """``matched`` events with ``stop`` and ``score`` of elements that could be the body, null for others.

    These are the elements and classes named or, if a page has none of them, all of FALLBACK. One that is never closed
    reaches to the page's end. The score is the text's length in hundreds, 5 a heading (h2 to h4), 3 a list, less 50 times
    the share of linked text, 10 more with the page's title in the text, 20 less for a class of navigation; 0 for texts
    below 200 characters.
    """
    rows = having(events, all=f"if(if(any, named, kind = 1 and {one_of(FALLBACK)}), struct(coalesce(end.i, all.i) as i, coalesce(end.length, all.length) as length, coalesce(end.headings, all.headings) as headings, coalesce(end.lists, all.lists) as lists, coalesce(end.linked, linked) as linked), null)")
    rows = having(rows, stop="all.i", size="all.length - length - 1")
    score = "size / 100 + 5 * (all.headings - headings) + 3 * (all.lists - lists) - 50 * ((all.linked - linked) / greatest(1, size)) + if(titled <= size, 10, 0) - if(lower(classes) rlike 'nav|footer|header|breadcrumb|menu', 20, 0)"
    return having(rows, score=f"case when stop is null then null when size < 200 then 0.0d else cast({score} as double) end").drop("named", "any", "all", "size", "known", "titled")


def body_events(events: DataFrame, removed=REMOVED, removed_classes=REMOVED_CLASSES) -> DataFrame:
    """Events inside the best body (the first of the highest score above 0) but for boilerplate, with depths and ``aside``.

    Boilerplate are the elements and classes given and hidden ones, with all in them; one that is never closed ends at the
    next block's tag. ``aside`` marks a heading (h2 to h4) that says "related" and what follows it up to the next heading
    beside it or the end of what holds it. A callout has one of its words in its class, or is a paragraph or a block
    without blocks that says "note:" or the like.
    """
    far = "over (partition by r order by i rows unbounded preceding)"
    rows = having(events, best="max(if(score > 0, struct(score, -i as back, stop), null)) over (partition by r)").where("i > -best.back and i < best.stop").drop("stop", "score", "best")
    rows = having(rows, paired="end is not null or start is not null", unwanted=f"kind > 0 and ({one_of(removed)} or {has_class(removed_classes)} or hidden)", own="if(kind = 1, classes, start.classes)")
    leaf = "name in ('p', 'div', 'section') and coalesce(end.block - block, block - start.block) = 1 and coalesce(end.warned - warned, warned - start.warned) > 0"
    marked = f"lower(own) rlike '{'|'.join(CALLOUT)}' and name not in ('a', 'li', 'td', 'th', 'tr')"
    rows = having(rows, callout=f"paired and ({leaf} or {marked}) and coalesce(end.length > length, length > start.length)")
    depth = lambda of: f"sum(if(paired and {of}, kind, 0)) {far}"
    rows = having(
        rows, covered=f"max(if(unwanted, coalesce(end.i, i), null)) {far}", open=f"max(if(unwanted and kind = 1 and end is null, block, null)) {far}", held=depth(one_of(HOLDERS)), listed=depth("name in ('ul', 'ol')"), coded=depth("name = 'pre'"),
        tables=depth("name = 'table'"), callouts=depth("callout"), quotes=depth("name = 'blockquote'"), in_cell=f"coalesce(last(if(name in ('td', 'th', 'tr', 'table', 'caption'), name in ('td', 'th') and kind = 1, null), true) {far}, false)",
    )
    rows = rows.where("not coalesce(covered >= i, false) and not coalesce(open = block, false)")
    rows = having(rows, stage=f"case when kind = 1 and name in ('h2', 'h3', 'h4') then held when kind = -1 and paired and {one_of(HOLDERS)} then held + 1 end")
    rows = having(rows, then="lead(i) over (partition by r, stage order by i)")
    return having(rows, aside=f"coalesce(max(if(kind = 1 and name in ('h2', 'h3', 'h4') and end.related > related, coalesce(then, 1 << 30) - 1, null)) {far} >= i, false)").drop("unwanted", "own", "covered", "open", "held", "stage", "then", "hidden")


def with_pieces(rows: DataFrame) -> DataFrame:
    """Body events with ``piece``, what each says in Markdown, and ``link``, what it adds to the list of links.

    Tables, callouts and quotes begin and end with a mark of their part, rows and cells with marks of theirs; of nested
    tables and callouts the outermost counts, and their words alone.
    """
    items = "over (partition by r, listed order by i rows unbounded preceding)"
    rows = having(rows, item=f"count_if(name = 'li' and kind = 1) {items}")
    rows = having(rows, first=f"last(if(name in ('ul', 'ol') and kind = 1 and paired, item, null), true) {items}", list=f"last(if(name in ('ul', 'ol') and kind = 1 and paired, name, null), true) {items}")
    full = "case kind when 1 then end.length > length when -1 then length > start.length end"
    rows = having(rows, target="if(kind = -1, start.href, href)", raw=H.unescaped("raw"), inline=f"{full} and coded = 0 and coalesce(end.block, start.block) = block", shallow="if(kind = 1, 1, 0)")
    code = f"replace(replace(regexp_replace(raw, '\\r\\n?', '\\n'), ' ', '{BLANK}'), '\\n', '{LINE}')"
    words = f"case when raw is null then '' when callouts > 0 then concat(' ', text) when tables > 0 then if(in_cell, concat(' ', text), '') when coded > 0 then {code} else regexp_replace(raw, '(?U)\\\\s+', ' ') end"
    bullet = f"concat(repeat('{INDENT}', cast(greatest(listed - 1, 0) as int)), if(list = 'ol', concat(item - coalesce(first, 0), '. '), '- '))"
    hashes = " ".join(f"when '{n}' then '{'#' * k} '" for n, k in LEVELS.items())
    rest = "if(quotes > 0, 'Q', 'P')"
    piece = f"""case when aside then '' when kind = 0 then {words}
      when callout and callouts = shallow and tables = 0 then concat('{PART}', if(kind = 1, 'C', {rest}))
      when name = 'table' and paired and callouts = 0 and tables = shallow then concat('{PART}', if(kind = 1, 'T', {rest}))
      when name = 'blockquote' and paired and callouts = 0 and tables = 0 and quotes = shallow then concat('{PART}', if(kind = 1, 'Q', 'P'))
      when tables > 0 and callouts = 0 then case when kind = 1 and name = 'tr' then '{ROW}' when kind = 1 and name in ('td', 'th') then '{CELL}' else '' end
      when callouts > 0 then ''
      when name = 'li' then if(kind = 1, concat('\\n', {bullet}), '')
      when name in ('ul', 'ol') then if(not paired or listed = shallow, '\\n\\n', '')
      when name = 'pre' then case when end is not null then '\\n\\n```{LINE}' when start is not null then '{LINE}```\\n\\n' else '\\n\\n' end
      when {one_of(LEVELS)} then concat('\\n\\n', if(kind = 1, case name {hashes} end, ''))
      when name = 'br' then if(coded > 0, '{LINE}', '\\n') when name = 'hr' then '\\n\\n---\\n\\n' when name = 'img' then picture
      when name = 'a' then if(inline and target <> '', if(kind = 1, '[', concat('](', if(startswith(target, 'mailto:'), target, {H.resolved('target', 'url')}), ')')), '')
      when name in ('strong', 'b') then if(inline, '**', '') when name in ('em', 'i') then if(inline, '*', '') when name = 'code' then if(inline, '`', '')
      when name in ('td', 'th', 'dt', 'dd') then '\\n' when name in ('p', 'div') and listed > 0 then if(kind = -1, ' ', '') when {one_of(BLOCKS)} then '\\n\\n' else '' end"""
    link = f"case when name = 'a' and kind = 1 then concat('{LINK}', if(aside, 'R', 'K'), href, '{LABEL}') when in_link and text <> '' then concat(text, ' ') else '' end"
    return rows.selectExpr("r", "i", f"coalesce({piece}, '') as piece", f"{link} as link")


def tidy(x: str) -> str:
    """Blanks and blank lines of Markdown put in order, headings and items without words dropped; stand-ins stay."""
    steps = ((" +", " "), (" ?\n ?", "\n"), (rf"(?m)^{INDENT}*(?:-|\d+\.) *$", ""), (r"(?m)^#+ *$", ""), ("\n{3,}", "\n\n"))
    return f"trim(both ' \\n' from {H.replaced(x, steps)})"


def table_markdown(part: str) -> str:
    """Lines for a table's rows: ``- a: b`` if all have two cells, else each row's cells under the first row's names."""
    rows = f"filter(transform(split({part}, '{ROW}'), r -> transform(slice(split(r, '{CELL}'), 2, length(r) + 1), c -> {H.compact('c')})), r -> size(r) > 0)"
    wide = "transform(slice(t_, 2, size(t_)), r -> concat('- ', array_join(transform(r, (v, k) -> concat(coalesce(get(t_[0], k), concat('Field ', k + 1)), ': ', v)), '; ')))"
    lines = f"if(forall(t_, r -> size(r) = 2), transform(t_, r -> concat('- ', r[0], ': ', r[1])), {wide})"
    return H.let("t_", rows, f"if(size(t_) = 0, '', array_join({lines}, '\\n'))")


def callout_markdown(part: str) -> str:
    label = "case when contains(lower(c_), 'warning') then 'Warning' when contains(lower(c_), 'important') then 'Important' when contains(lower(c_), 'tip') then 'Tip' else 'Note' end"
    return H.let("c_", H.compact(part), f"concat('> ', {label}, ': ', c_)")


def folded(rows: DataFrame) -> DataFrame:
    """``r, markdown, links`` of each page with a body: its events joined in order, parts into Markdown, parts into the whole."""
    events = rows.where("piece <> '' or link <> ''").groupBy("r").agg(F.expr("array_sort(collect_list(struct(i, piece, link)))").alias("e"))
    text = having(events, piece=f"concat('{PART}P', array_join(e.piece, ''))", link="array_join(e.link, '')")
    quoted = H.let("q_", tidy("substring(p, 2)"), "if(q_ = '', '', regexp_replace(q_, '(?m)^', '> '))")
    part = f"case substring(p, 1, 1) when 'T' then {table_markdown('substring(p, 2)')} when 'C' then {callout_markdown('substring(p, 2)')} else {quoted} end"
    said = f"array_join(transform(slice(split(piece, '{PART}'), 2, length(piece)), p -> if(startswith(p, 'P'), substring(p, 2), concat('\\n\\n', {part}, '\\n\\n'))), '')"
    links = f"filter(transform(slice(split(link, '{LINK}'), 2, length(link) + 1), x -> struct(substring(x, 1, 1) as mark, substring(substring_index(x, '{LABEL}', 1), 2) as href, {H.compact(f"substring_index(x, '{LABEL}', -1)")} as label)), x -> x.href <> '')"
    whole = having(text, said=said)
    return whole.selectExpr("r", f"replace(replace(replace({tidy('said')}, '{INDENT}', '  '), '{BLANK}', ' '), '{LINE}', '\\n') as markdown", f"{links} as links")


def bodies(pages: DataFrame, bodies=BODIES, body_classes=BODY_CLASSES, removed=REMOVED, removed_classes=REMOVED_CLASSES) -> DataFrame:
    """``r, markdown, links`` of the body of each of ``pages`` (``r, page_id, url, title, html``) that has one; links are ``{mark, href, label}``.

    Repeated rows give one.
    """
    return folded(with_pieces(body_events(scored(matched(tag_events(pages.dropDuplicates(["r"]), body_classes), bodies, body_classes)), removed, removed_classes)))


def keyed(pages: DataFrame) -> DataFrame:
    """``pages`` (``page_id, base, html``) with ``r``, a digest of the whole row, dealt by it once for all that follows.

    A digest stays the same however often a lost page is read again; repeated rows share it. The number of partitions is
    the session's, not one by bytes: a page's events cost far more than its bytes tell.
    """
    own = F.concat_ws("\x00", F.coalesce(F.col("page_id").cast("string"), F.lit("\x01")), "base", "html")
    return pages.withColumn("r", F.unhex(F.md5(own))).repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "r")
