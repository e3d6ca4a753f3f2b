"""The queries of the operators that SQL can express, for a second engine over the same tables."""

from __future__ import annotations

from pitwright.llm.decontamination import SIMILARITY, WINDOW
from pitwright.llm.license_scan import CONTENT, DENSITY, FILE_SHARE, FILES, SHORT_LINE, TEMPLATES, THRESHOLD
from pitwright.llm.quality import BARS, BOILERPLATE, LONG
from pitwright.llm.url_filter import CANONICAL, REFRESH

_SPACE = r"[ \t\n\x0B\f\r]"

#: Repeated words: windows of 8 words by their own text, so that nothing is shared with the hashing of the operator.
OP9 = rf"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
w as (select row, doc_id, text, list_filter(string_split_regex(text, '{_SPACE}+'), lambda x: x <> '') as words, string_split(text, chr(10)) as lines from d),
win as (select row, unnest(range(1, len(words) - 6)) as i, unnest(list_transform(range(1, len(words) - 6), lambda i: md5(array_to_string(words[i:i + 7], ' ')))) as h from w where len(words) >= 8),
twice as (select row, i from (select row, i, count(*) over (partition by row, h) as n from win) a where n > 1),
steps as (select row, least(8, coalesce(lead(i) over (partition by row order by i) - i, 8)) as k from twice),
rep as (select row, sum(k) as n_repeat_words from steps group by row),
l as (select row, unnest(lines) as x, unnest(range(1, len(lines) + 1)) as i from w),
c as (select *, len(regexp_extract_all(x, '[^ \t\n\x0B\f\r]+')) as n, len(regexp_extract_all(x, '[#*$%&|<>=_~^]+|[!?]{{2,}}')) as marks, len(regexp_extract_all(x, '{BARS}')) as bars from l),
j as (select *, not (
   (n > 0 and (marks > 0.3 * n or not regexp_matches(x, '\p{{L}}') or (n >= {LONG} and not regexp_matches(x, '[.!?;:]'))))
   or (bars >= 2 and 4 * bars >= n) or (n <= 25 and regexp_matches(lower(x), '{BOILERPLATE}'))) as good from c),
g as (select row, count(case when n > 0 then 1 end) - count(distinct case when n > 0 then x end) as n_dup_lines,
   coalesce(sum(case when good then length(x) end), 0) + greatest(count(case when good then 1 end) - 1, 0) as n_left from j group by row),
q as (select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
   n_dup_lines::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, case when length(text) > 0 then n_left / length(text) else 0 end as left_share
   from w join g on g.row = w.row left join rep on rep.row = w.row)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
   not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and left_share >= 0.5 as kept from q"""


def _fits(rule: str) -> str:
    at, slash, tail = rule.partition("/")
    return f"((host = '{at}' or ends_with(host, '.{at}')) and starts_with(path, '{slash}{tail}'))"


def op3(rules: list[tuple[str, str]]) -> str:
    """Longest fitting rule, else the decision of the component of aliases, which are walked from each page's node."""
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule = "case " + " ".join(f"when {_fits(t)} then '{t}'" for _, t in longest) + " end"
    verdict = "case " + " ".join(f"when {_fits(t)} then '{k}'" for k, t in longest) + " end"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = lambda u: f"translate(regexp_extract({u}, '://([^/?#]*)', 1), '{upper}', '{lower}')"
    path = lambda u: f"regexp_extract({u}, '://[^/?#]*([^?#]*)', 1)"
    rest = lambda u: f"regexp_extract({u}, '://[^/?#]*([^#]*)', 1)"
    node = lambda u: f"case when {host(u)} <> '' then {host(u)} || case when starts_with({rest(u)}, '/') then {rest(u)} else '/' || {rest(u)} end end"
    folder = f"coalesce(nullif(regexp_extract({path('url')}, '^(.*/)', 1), ''), '/')"
    resolved = f"""case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t when starts_with(t, '//') then 'x:' || t when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
        when starts_with(t, '/') then 'x://' || {host("url")} || t when starts_with(t, '#') then null when starts_with(t, '?') then 'x://' || {host("url")} || {path("url")} || t else 'x://' || {host("url")} || {folder} || t end"""
    tag = lambda name, mark, value: f"""nullif(replace(regexp_extract(regexp_extract(html, '(?is)<{name}\\b[^>]*?\\b{mark}\\b[^>]*>', 0), '{value}', 1), '&amp;', '&'), '')"""
    canonical = tag("link", CANONICAL.replace("'", "''"), "(?is)\\bhref\\s*=\\s*[\"'']?([^\"''\\s>]+)")
    refresh = tag("meta", REFRESH.replace("'", "''"), "(?is)\\burl\\s*=\\s*[\"'']?([^\"''\\s>;]+)")
    return f"""
with recursive named as (select url, {canonical} as t from pages union all select url, {refresh} from pages), targets as (select {node("url")} as src, {resolved} as target from named where t is not null),
e as (select distinct src, {node("target")} as dst from targets where src is not null and target is not null), both_ways as (select src, dst from e where src <> dst union select dst, src from e where src <> dst and dst is not null),
reach(a, b) as (select distinct src, src from both_ways union select r.a, x.dst from reach r join both_ways x on x.src = r.b),
seen as (select a, {host("'x://' || b")} as host, {path("'x://' || b")} as path from reach), own as (select a, {verdict} as v from seen),
carried as (select a, case when bool_or(v = 'allow') then 'allow' else 'block' end as carried from own where v is not null group by a),
p as (select page_id, coalesce({host("url")}, '') as host, coalesce({path("url")}, '') as path, {node("url")} as alias from pages)
select page_id, host, path, {rule} as rule, coalesce({verdict}, carried, 'allow') as verdict, carried from p left join carried c on c.a = p.alias"""

#: The digest's bits as text, five at a time; of pages with equal payloads that with the smallest id is the response.
OP5 = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
b as (select *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(hex, i, 1)) - 1)::int + 1, 4)), '') as bits from p),
d as (select page_id, html, octet_length(encode(html))::bigint as payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  16 * substr(bits, 5 * k::int + 1, 1)::int + 8 * substr(bits, 5 * k::int + 2, 1)::int + 4 * substr(bits, 5 * k::int + 3, 1)::int + 2 * substr(bits, 5 * k::int + 4, 1)::int + substr(bits, 5 * k::int + 5, 1)::int + 1, 1)), '') as payload_digest from b),
f as (select *, min(page_id) over (partition by html) as first_id from d)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to from f"""


def op10() -> str:
    """Headers weighted over all documents, their best templates and those of whole licence files, then the nearest directory above
    that has a licence file."""
    values = lambda texts: ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(texts))
    split = lambda c: f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"
    words = lambda c: rf"len(regexp_extract_all({c}, '[^ \t\n\x0B\f\r]+'))"

    def scored(p: str, key: str, templates: str, spread: str) -> str:
        """{p}best: the best template of each key of spread (key, term, tf)."""
        return f"""{p}tt as (select template, term, count(*) as tf from (select template, unnest({split("text")}) as term from {templates}) a group by all),
{p}w as (select {key}, s.term, tf * (ln((1 + total) / (1 + coalesce(df, 1))) + 1) as w from {spread} s left join df on df.term = s.term, total), {p}norms as (select {key}, sqrt(sum(w * w)) as norm from {p}w group by {key}),
{p}tw as (select template, x.term, tf * (ln((1 + total) / (1 + coalesce(df, 1))) + 1) as tw from {p}tt x left join df on df.term = x.term, total), {p}t_norm as (select template, sqrt(sum(tw * tw)) as t_norm from {p}tw group by template),
{p}dots as (select {key}, template, sum(w * tw) as dot from {p}w w join {p}tw tw on tw.term = w.term group by all),
{p}ranked as (select o.{key}, licence, round(dot / norm / t_norm, 6) as similarity, row_number() over (partition by o.{key} order by round(dot / norm / t_norm, 6) desc, o.template) as k from {p}dots o join {p}norms n on n.{key} = o.{key} join {p}t_norm x on x.template = o.template join {templates} t on t.template = o.template),
{p}best as (select {key}, licence, similarity from {p}ranked where k = 1 and similarity >= {THRESHOLD})"""

    return f"""
with t(template, licence, text) as (values {values(TEMPLATES)}), f(template, licence, text) as (values {values(FILES)}),
d as (select row_number() over () as row, doc_id, coalesce(text, '') as text, list_filter(string_split(coalesce(source, '') || '/' || coalesce(lang, ''), '/'), lambda x: x <> '') as parts from documents),
l as (select row, line, {split("line")} as terms from (select row, unnest(string_split(text, chr(10))) as line from d) a),
known as (select row, line, len(list_intersect(terms, {list(CONTENT)})) as known, len(list_distinct(terms)) as n from l),
h as (select row, line from known where (known >= 2 or (known = 1 and n <= {SHORT_LINE})) and {DENSITY} * known >= n), lines as (select line, count(*) as n from h group by line), total as (select coalesce(sum(n), 0) as total from lines),
s as (select line, n, term, count(*) as tf from (select line, n, unnest({split("line")}) as term from lines) a group by all), df as (select term, sum(n) as df from s group by term),
{scored("l_", "line", "t", "s")},
whole as (select d.row, text from d join (select row, sum({words("line")}) as n from h group by row) x on x.row = d.row where x.n >= {FILE_SHARE} * {words("text")}),
fs as (select row, term, count(*) as tf from (select row, unnest({split("text")}) as term from whole) a group by all),
{scored("f_", "row", "f", "fs")},
own as (select row, max((similarity, licence)) as b from (select row, similarity, licence from h join l_best on l_best.line = h.line union all select row, similarity, licence from f_best) a group by row),
j as (select doc_id, parts, array_to_string(parts, '/') as directory, b[2] as own_licence, b[1] as similarity, b is not null and d.row in (select row from whole) as is_file from d left join own on own.row = d.row),
given as (select directory as path, own_licence as given from (select directory, own_licence, row_number() over (partition by directory order by count(*) desc, own_licence) as k from j where is_file group by directory, own_licence) a where k = 1),
up as (select directory, k as depth, array_to_string(parts[1:k], '/') as path from (select distinct directory, parts from j) a, unnest(range(0, len(parts) + 1)) as u(k)),
near as (select directory, given, path from (select directory, given, up.path, row_number() over (partition by directory order by depth desc) as k from up join given on given.path = up.path) a where k = 1)
select doc_id, j.directory, own_licence, similarity, is_file, coalesce(own_licence, given) as licence, case when own_licence is not null then '.' when given is not null then '/' || path end as licence_from from j left join near on near.directory = j.directory"""


def op2() -> str:
    """No seeds: every word of a text is laid beside every equal word of an item, and the matches are counted on each diagonal."""
    unspaced = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
    words = rf"list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '{unspaced}', ' \1 ', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return f"""
with d as (select row_number() over () as row, doc_id, {words} as w from documents), i as (select item_id, {words} as w from benchmark), dw as (select row, unnest(w) as word, unnest(range(len(w))) as pos from d),
iw as (select item_id, least(len(w), {WINDOW}) as width, unnest(w) as word, unnest(range(len(w))) as ipos from i), m as (select row, item_id, width, pos - ipos as shift, ipos from dw join iw on iw.word = dw.word),
far as (select row, item_id, shift from m group by row, item_id, shift having count(*) >= {SIMILARITY} * min(width)),
c as (select row, item_id, width, shift, count(*) over (partition by row, item_id, shift order by ipos range between width - 1 preceding and current row) as k from m semi join far using (row, item_id, shift)),
g as (select row, item_id, shift, max(k) / min(width) as similarity, count(*) as n_matched, max(k) as k, min(width) as width from c group by row, item_id, shift having max(k) >= {SIMILARITY} * min(width)),
top as (select *, row_number() over (partition by row, item_id order by similarity desc, n_matched desc, shift) as n from g)
select doc_id, item_id, n_matched, round(similarity, 6) as similarity, shift as first_word from top join d on d.row = top.row where n = 1"""


def crc32(text: str) -> str:
    table = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    digit = lambda n: f"(strpos('0123456789ABCDEF', substr(h, {n}, 1)) - 1)"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: 16 * {digit(1)} + {digit(2)})"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


def op7(shards: int = 8, tries: int = 64, rounds: int = 4) -> str:
    """The least capacity among `tries` of them, then between it and the one before, and so on; each is cut by joins to the ends."""
    crc = crc32("coalesce(text, '')")
    steps = lambda p, start: ", ".join([f"{p}0 as ({start})", *(f"{p}{k} as (select s.cap, s.total, greatest(s.reached, coalesce(e.ending, 0)) as reached from {p}{k - 1} s asof left join e on s.reached + s.cap >= e.ending)" for k in range(1, shards + 1))])
    search = [
        steps(f"r{r}s", f"select distinct low + (high - low) * j // {tries - 1} as cap, total, 0::bigint as reached from p{r}, (select unnest(range({tries})) as j) t") + f""",
p{r + 1} as (select coalesce(max(case when reached < total then cap end) + 1, min(cap)) as low, min(case when reached >= total then cap end) as high, min(total) as total from r{r}s{shards})"""
        for r in range(rounds)
    ]
    return f"""
with d as (select doc_id, text, case when text is null then 1 else octet_length(encode(text)) + 1 end::bigint as size, case when text is null then '' else sha256(text) end as key, ({crc})::bigint as text_crc32 from documents),
g as (select key, sum(size)::bigint as bytes from d group by key), e as (select key, (sum(bytes) over (order by key))::bigint as ending from g),
p0 as (select greatest(big, (total + {shards - 1}) // {shards}) as low, least(total, greatest(big, (total + {shards - 1}) // {shards}) + big) as high, total from (select max(bytes) as big, sum(bytes)::bigint as total from g) a),
{", ".join(search)}, {steps("f", f"select high as cap, total, 0::bigint as reached from p{rounds}")},
cuts as ({" union all ".join(f"select reached from f{k}" for k in range(1, shards + 1))}), placed as (select e.key, (select count(*) from cuts where reached < e.ending)::int as shard from e)
select doc_id, size, text_crc32, 'bytes' as law, shard, (row_number() over (partition by shard order by d.key, doc_id) - 1)::bigint as slot, null::int as grown_shard from d join placed on placed.key = d.key"""


def op11(levels: int = 20) -> str:
    """Windows of 2^k words that stand twice in a text, by the first place of their halves; of a window at least as long as the
    period of the run that it lies in, the next place is one period on. Such periods are then tried on all words of the text."""
    named = "n0 as (select row, i, min(i) over (partition by row, word) as name, lead(i) over (partition by row, word order by i) - i as gap, count(*) over (partition by row, word) as n from words)" + "".join(
        f""",
n{k + 1} as (select row, i, min(i) over (partition by row, a, b) as name, lead(i) over (partition by row, a, b order by i) - i as gap, count(*) over (partition by row, a, b) as n
   from (select x.row, x.i, x.name as a, y.name as b from n{k} x join n{k} y on y.row = x.row and y.i = x.i + {1 << k} where x.n > 1 and y.n > 1) a)"""
        for k in range(levels)
    )
    periods = " union ".join(f"select row, gap as q from n{k} where gap > {(1 << k) // 2} and gap <= {1 << k}" for k in range(levels + 1))
    return f"""
with s as (select row_number() over () as row, doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') as w, ({crc32("doc_id::varchar")})::bigint as h from documents),
a as (select *, len(w) as n, len(w) > 0 and h % 10 = 0 as planted, case when len(w) > 0 then (h // 10) % len(w) end as a from s), p as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from a),
d as (select row, doc_id, case when planted then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) else w end as w from p),
words as (select row, unnest(w) as word, unnest(range(len(w))) as i from d),
{named},
periods as ({periods}), same as (select q.row, q, x.i from periods q join words x on x.row = q.row join words y on y.row = q.row and y.i = x.i + q and y.word = x.word),
island as (select row, q, i, i - row_number() over (partition by row, q order by i) as g from same),
r as (select row, start, length, min(q) as period from (select row, q, min(i) as start, count(*) + q as length from island group by row, q, g) b where length >= greatest(6, 4 * q) group by row, start, length),
gone as (select distinct row, i from (select row, unnest(range(start + period, start + length)) as i from r) b),
left_over as (select row, string_agg(word, ' ' order by i) as text from words anti join gone using (row, i) where row in (select row from r) group by row),
best as (select *, row_number() over (partition by row order by length desc, start, period) as k from r),
every as (select row, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs from r group by row)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, start::bigint as start, length::bigint as length, period::bigint as period, (1000 * length // period)::bigint as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256,
   sha256(coalesce(left_over.text, array_to_string(w, ' '))) as collapsed_sha256
from d left join every using (row) left join best on best.row = d.row and k = 1 left join left_over on left_over.row = d.row"""


def op13() -> str:
    """Nodes by whole lists of turns; every prefix of a node's list is an ancestor."""
    return f"""
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as pos, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
own as (select c, list(md5(role || chr(0) || text) order by pos) as turns, list(octet_length(encode(text)) order by pos) as sizes from t group by c),
b as (select x.c, ({crc32("x.c::varchar")}) % 9 as h, x.turns, x.sizes, coalesce(y.turns, []) as base, coalesce(y.sizes, []) as base_sizes from own x left join own y on y.c = x.c - x.c % 5),
r as (select c, list_concat(base[1:h], turns[h + 1:]) as turns, list_concat(base_sizes[1:h], sizes[h + 1:]) as sizes from b),
m as (select c, d, md5(array_to_string(turns[1:d], ',')) as node, md5(array_to_string(turns[1:d - 1], ',')) as parent, case when d > 0 then sizes[d] else 0 end as bytes, d = len(turns) as ending, turns from (select c, turns, sizes, unnest(range(len(turns) + 1)) as d from r) a),
n as (select d, node, min(parent) as parent, min(c) as conv_id, count(*) as n_convs, max(bytes) as bytes, min(turns[1:d]) as line, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where ending), '')) as ends_sha256 from m group by d, node),
kids as (select d - 1 as d, parent as node, count(*) as n_children from n where d > 0 group by all),
v as (select n.*, coalesce(n_children, 0) as n_children from n left join kids using (d, node)),
up as (select e as d, md5(array_to_string(line[1:e], ',')) as node, n_children = 0 as leaf, (n_convs - 1) * bytes as saved from (select *, unnest(range(d + 1)) as e from v) a),
s as (select d, node, count(*) filter (where leaf) as n_leaves, sum(saved) as saved_tokens from up group by all)
select v.conv_id, v.d::bigint as depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, v.ends_sha256
from v join s on s.d = v.d and s.node = v.node left join n p on v.d > 0 and p.d = v.d - 1 and p.node = v.parent"""
