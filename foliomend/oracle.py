"""DuckDB's SQL for the registered queries that SQL can say."""

from __future__ import annotations

from foliomend.functions.text import ACCENTS, APOSTROPHES, DROPPED_GLYPH, ENGLISH, ENGLISH_VOTE, FRENCH, GERMAN, GERMAN_VOTE, LIGATURES, PHRASES

_CORPORA = ("healthy", "wordsplit_damaged", "glued_damaged")


def _files(*names: str) -> str:
    parts = " union all ".join(f"select file_id, rel, text from {n}" for n in names or _CORPORA)
    return f"files as (select file_id, any_value(rel) as rel, any_value(text) as text from ({parts}) group by file_id)"


def _in(words: tuple[str, ...] | list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _count(literal: str, text: str = "text") -> str:
    return f"((length({text}) - length(replace({text}, '{literal}', ''))) // {len(literal)})"


def _tokens(least: int = 1, text: str = "text") -> str:
    return f"list_transform(regexp_extract_all({text}, '[A-Za-z]{{{least},}}'), lambda x: lower(x))"


def _votes(words: tuple[str, ...] | list[str], array: str = "t") -> str:
    return f"len(list_filter({array}, lambda x: x in {_in(words)}))"


_CJK = r"len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]')) / greatest(length(text), 1)::double"
_ANCHOR = r"(contains(text, chr(12)) or regexp_matches(text, '(?i)={3,}\s*(?:page|omnibus\s*p\.?)\s*\d+'))"
_PHRASES = " + ".join(_count(p) for p in PHRASES)
_GOOD = " + ".join(_count(a) for a, _ in ACCENTS)
_BAD = " + ".join(_count(b) for _, b in ACCENTS)
_GLUE = "case when len(t) >= 300 then len(list_filter(t, lambda x: length(x) >= 18)) / len(t)::double * 1000 end"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_GARBLED = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFF}\x{FFFD}\x00-\x08\x0E-\x1B\x{80}-\x{84}\x{86}-\x{9F}]"


def _lexicon(source: str = "files", least: int = 2) -> str:
    return f"(select w, count(*) as tf from (select unnest({_tokens(least)}) as w from {source}) group by w)"


def _pairs(source: str = "files") -> str:
    return f"""(select file_id, w as a, lead(w) over (partition by file_id order by i) as b
    from (select file_id, unnest(t) as w, generate_subscripts(t, 1) as i from (select file_id, {_tokens()} as t from {source})))"""


def _split(floor: int, lexicon: str = "lex", source: str = "files") -> str:
    return f"""hits as (select p.file_id, count(*) as hits from {_pairs(source)} p join {lexicon} j on j.w = p.a || p.b
    left join {lexicon} x on x.w = p.a left join {lexicon} y on y.w = p.b
    where length(p.a || p.b) >= 5 and j.tf >= 30 and j.tf > 3 * greatest(coalesce(x.tf, 0), coalesce(y.tf, 0)) group by p.file_id),
rates as (select f.file_id, len({_tokens()}) as tokens, coalesce(hits, 0) as pairs,
    case when len({_tokens()}) >= {floor} then coalesce(hits, 0) / greatest(len({_tokens()}), 1)::double * 1000 end as splitpair
    from {source} f left join hits using (file_id) where text is not null)"""


_RATES = f"with {_files()}, lex as {_lexicon()}, {_split(300)}"
_CLEAN_SPLITS = f"""with {_files()}, lex as {_lexicon(least=1)}, {_split(300)},
clean as (select f.* from files f join rates using (file_id) where coalesce(splitpair, 0) < 2.0 and coalesce({_CJK}, 0) <= 0.05)"""
_CLEAN_GLUE = f"with {_files()}, clean as (select * from (select *, {_tokens()} as t from files) where {_GLUE} < 1.5 and {_CJK} <= 0.05)"


def _frequencies(source: str) -> str:
    return f"(select w, count(*) as tf, count(distinct file_id) as df from (select file_id, unnest({_tokens()}) as w from {source} where text is not null) group by w)"


_HEALTH = f"""{_RATES},
base as (select f.file_id, length(text) as chars, {_tokens()} as t, {_CJK} as cjk, {_PHRASES} as phrases, {_GOOD} as acc_good, {_BAD} as acc_bad, {_ANCHOR} as page_ok, splitpair as sp
    from files f join rates using (file_id) where length(text) >= 2000),
health as (select file_id, chars, len(t) as words, cjk, 0 as glue_x, {_votes(GERMAN_VOTE)} > {_votes(ENGLISH_VOTE)} as de, phrases / greatest(len(t), 1)::double * 10000 as phrase,
    acc_good, acc_bad, page_ok, {_GLUE} as glue, case when acc_good + acc_bad >= 5 then acc_bad / (acc_good + acc_bad)::double * 100 end as acc_ratio, sp from base),
latin as (select phrase, row_number() over (order by phrase) as r, count(*) over () as n from health where cjk <= 0.05),
med as (select coalesce(max(phrase), 0) as m from latin where r = n // 2 + 1),
flags as (select health.*, cjk <= 0.05 and phrase < m * 0.15 as gate1, coalesce(acc_ratio > 50, false) as gate2, not page_ok as gate4,
    cjk <= 0.05 and coalesce(sp >= 5, false) as gate5, cjk <= 0.05 and not de and coalesce(glue >= 3, false) as gate6 from health, med)"""

_GARBLE = rf"""rows as (select doc_id, length(text) - len(regexp_extract_all(text, '{_SPACE}')) as total, len(regexp_extract_all(text, '{_GARBLED}')) as bad, regexp_matches(text, '\(cid:\d+\)') as c from documents),
garble as (select doc_id, case when total > 0 then bad / total::double else 0 end as rate, case when total > 0 then bad else 0 end as garbled, coalesce(total, 0) as total, case when total > 0 then c else false end as cid from rows),
g as (select *, cid or rate * 1000 >= 0.1 as flagged from garble)"""

_LETTER = r"\p{L}\p{N}_"
_HYPHENS = rf"""{_files()},
plain as (select lower(w) as w, count(*) as tf from (select unnest(string_split_regex(text, '[^{_LETTER}]+')) as w from files) where regexp_full_match(w, '[A-Za-z]{{3,}}') group by 1),
chunks as (select unnest(string_split_regex(text, '[^{_LETTER}-]+')) as c from files),
marked as (select array_to_string(list_transform(string_split(c, '-'), lambda x: case when regexp_full_match(x, '[A-Za-z]{{2,}}') then x else '#' end), '-') as c from chunks where contains(c, '-')),
hyph as (select lower(w) as w, count(*) as tf from (select unnest(regexp_extract_all(c, '[A-Za-z]{{2,}}-[A-Za-z]{{2,}}')) as w from marked) group by 1)"""
_SITES = rf"""{_HYPHENS},
raw as (select file_id, unnest(s) as site, generate_subscripts(s, 1) - 1 as pos from (select file_id, regexp_extract_all(text, '[A-Za-z]{{2,}}-\r?\n[a-z]{{2,}}') as s from files)),
parts as (select file_id, pos, site, regexp_extract(site, '^[A-Za-z]+') as a, regexp_extract(site, '[a-z]+$') as b from raw),
sites as (select p.*, coalesce(pl.tf, 0) as plain_tf, coalesce(h.tf, 0) as hyphen_tf from parts p left join plain pl on pl.w = lower(a || b) left join hyph h on h.w = lower(a || '-' || b)),
judged as (select *, case when plain_tf >= 3 and plain_tf > 2 * hyphen_tf then 'JOIN' when hyphen_tf >= 2 and hyphen_tf > plain_tf then 'HYPH' else 'SKIP' end as verdict from sites)"""


def _ligatures() -> str:
    out = "text"
    for glyph, letters in (*LIGATURES, (DROPPED_GLYPH, "")):
        out = f"replace(regexp_replace({out}, '{glyph} ([{_LETTER}])', '{letters}\\1', 'g'), '{glyph}', '{letters}')"
    return out


def _md5(column: str, name: str | None = None) -> str:
    return f"md5({column}) as {name or column}"


def _line_joined(text: str) -> str:
    """A text with lines joined at their ends' hyphens."""
    x = f"string_split({text}, chr(10))"
    joins = rf"""regexp_matches({x}[i], '[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]-$') and regexp_matches({x}[i], '(^|[^{_LETTER}])[\p{{L}}\p{{N}}]+[^{_LETTER}]*$') and regexp_matches({x}[i + 1], '^[^{_LETTER}]*[\p{{L}}\p{{N}}]+($|[^{_LETTER}])')"""
    return f"array_to_string(list_transform(range(1, len({x}) + 1), lambda i: case when i = len({x}) then {x}[i] when {joins} then left({x}[i], length({x}[i]) - 1) else {x}[i] || chr(10) end), '')"


def _tokens_of(source: str, name: str, more: str = "") -> str:
    """Tokens of texts in order, with what stands after each, the next one, and what stands before."""
    return rf"""{name}_p as materialized (select file_id, {more} regexp_extract(text, '^[^A-Za-z]*') as front, unnest(p) as piece, generate_subscripts(p, 1) as i from (select file_id, {more} text, regexp_extract_all(text, '[A-Za-z]+[^A-Za-z]*') as p from {source})),
{name} as materialized (select file_id, {more} front, i, tok, sep, lead(tok) over f as nxt, lag(sep, 1, front) over f as before from (select file_id, {more} front, i, regexp_extract(piece, '^[A-Za-z]+') as tok, regexp_extract(piece, '[^A-Za-z]*$') as sep from {name}_p) window f as (partition by file_id order by i))"""


def _walked(flags: str, name: str) -> str:
    """Flags (file_id, i, ok) with joins: of a run of pairs that may be joined, every other one, beginning with the first."""
    return f"""{name}_r as (select file_id, i, i - row_number() over (partition by file_id order by i) as run from {flags} where ok),
{name}_j as (select file_id, i, row_number() over (partition by file_id, run order by i) % 2 = 1 as joins from {name}_r),
{name} as materialized (select t.*, coalesce(joins, false) as joins from {flags} t left join {name}_j using (file_id, i))"""


def _put_together(source: str, name: str, texts: str) -> str:
    """Texts of tokens, without what stood between those that were joined; texts without tokens as they are."""
    return f"""{name} as materialized (select x.file_id, coalesce(y.text, x.text) as text, coalesce(y.joins, 0) as joins from {texts} x left join
(select file_id, any_value(front) || string_agg(tok || case when joins then '' else sep end, '' order by i) as text, sum(joins::int)::bigint as joins from {source} group by file_id) y using (file_id))"""


_ACCEPTS = """length(tok || nxt) >= 5 and coalesce(j.tf, 0) >= 30 and j.tf > 3 * greatest(coalesce(x.tf, 0), coalesce(y.tf, 0))"""


def _one_walk(source: str, k: object) -> str:
    return f"""{_tokens_of(source, f"tk{k}")},
fl{k} as (select t.*, coalesce(sep = ' ' and {_ACCEPTS}, false) as ok from tk{k} t left join lex j on j.w = lower(tok || nxt) left join lex x on x.w = lower(tok) left join lex y on y.w = lower(nxt)),
{_walked(f"fl{k}", f"wk{k}")}, {_put_together(f"wk{k}", f"tx{k}", source)}"""


_WALK_FROM = f"""with {_files("wordsplit_damaged")}, lex as materialized {_lexicon()}, tx0 as materialized (select file_id, text from files where text is not null)"""
_WALK = f"""{_WALK_FROM}, {_one_walk("tx0", 1)} select file_id, {_md5("text")}, joins from tx1"""
_FIXPOINT = f"""{_WALK_FROM}, {", ".join(_one_walk(f"tx{k - 1}", k) for k in range(1, 13))}
select tx12.file_id, md5(tx12.text) as text, {" + ".join(f"tx{k}.joins" for k in range(1, 13))} as joins from tx12 {" ".join(f"join tx{k} using (file_id)" for k in range(1, 12))}"""
_CONSUMING = f"""{_WALK_FROM}, {_tokens_of("tx0", "tk")},
ch as (select *, sum((before <> ' ' or i = 1)::int) over (partition by file_id order by i) as chain from tk),
wk as (select t.*, coalesce(sep = ' ' and row_number() over (partition by t.file_id, chain order by t.i) % 2 = 1 and {_ACCEPTS}, false) as joins from ch t left join lex j on j.w = lower(tok || nxt) left join lex x on x.w = lower(tok) left join lex y on y.w = lower(nxt)),
{_put_together("wk", "tx1", "tx0")} select file_id, {_md5("text")}, joins from tx1"""

_NON_WORDS = rf"""dict as (select distinct lower(w) as w from lexicon where w is not null),
whole as (select file_id, list_transform(regexp_extract_all(regexp_replace(text, '-{_SPACE}*\n{_SPACE}*', '', 'g'), '[A-Za-z]+'), lambda x: lower(x)) as t from src where text is not null),
pos as (select file_id, unnest(case when len(t) > 0 then t else [null] end) as w, generate_subscripts(case when len(t) > 0 then t else [null] end, 1) as i from whole),
nxt as (select *, lead(w) over (partition by file_id order by i) as nw, w in (from dict) as known from pos),
flag as (select *, (w || nw) in (from dict) and (not known or not coalesce(lead(known) over (partition by file_id order by i), true)) as halves from nxt),
fin as (select *, coalesce(halves, false) or coalesce(lag(halves) over (partition by file_id order by i), false) as dropped from flag),
counted as (select file_id, sum((w is not null and not dropped and length(w) >= 3)::bigint)::bigint as words, sum((w is not null and not dropped and length(w) >= 3 and not known)::bigint)::bigint as bad from fin group by file_id)"""


def _non_words(name: str) -> str:
    return f"(with {_files(name)}, src as (from files), {_NON_WORDS} select file_id, coalesce(words, 0) as words, coalesce(bad, 0) as bad from counted)"


_MERGES = f"""{_CLEAN_SPLITS}, fr as materialized {_frequencies("clean")}, n as (select count(*) as n from clean), cuts as (select tf, w[1:k] as a, w[k + 1:] as b from (select w, tf, unnest(range(1, length(w))) as k from fr where tf >= 20)),
both_ as (select c.*, coalesce(x.tf, 0) as ta, coalesce(y.tf, 0) as tb, case when length(a) = 1 then a in ('a', 'i') else coalesce(x.df, 0) / greatest(n.n, 1)::double >= 0.06 end as a_word, case when length(b) = 1 then b in ('a', 'i') else coalesce(y.df, 0) / greatest(n.n, 1)::double >= 0.06 end as b_word
    from cuts c cross join n left join fr x on x.w = a left join fr y on y.w = b),
merges as materialized (select a, b, not (a_word and b_word) or tf > 10 * least(ta, tb) as mergeable, a_word, b_word from both_)"""
_HYPHEN_LIKE = "chr(8208) || chr(8209) || chr(8210) || chr(8211) || chr(8212) || chr(173) || chr(9) || chr(10) || chr(13)"
_SAME_SEP = f"regexp_replace(translate(sep, {_HYPHEN_LIKE}, '------   '), ' +', ' ', 'g')"
_SEP_OK = f"length(sep) <= 4 and {_SAME_SEP} in (' ', '-', ' -', '- ')"


def _repair_pass(k: int) -> str:
    """One walk of split repair over texts tx{k-1}, of those that the last walk changed."""
    guard = """not (length(nxt) = 1 and (a_word or length(tok) = 1 and (tok <> lower(tok) or nxt <> lower(nxt)))) and not (length(tok) = 1 and tok <> lower(tok) and b_word)"""
    return f"""{_tokens_of(f"(select * from tx{k - 1} where live)", f"tk{k}")},
fl{k} as materialized (select t.*, coalesce({_SEP_OK} and not right(before, 1) in (chr(39), '’') and m.a is not null, false) as fact, coalesce({_SEP_OK} and not right(before, 1) in (chr(39), '’') and mergeable and {guard}, false) as ok from tk{k} t left join merges m on m.a = lower(tok) and m.b = lower(nxt)),
{_walked(f"fl{k}", f"wk{k}")}, sk{k} as (select file_id, sum((fact and not ok and not before_joins)::int)::bigint as skipped from (select *, lag(joins, 1, false) over (partition by file_id order by i) as before_joins from wk{k}) group by file_id),
{_put_together(f"wk{k}", f"ty{k}", f"tx{k - 1}")},
tx{k} as materialized (select t.file_id, t.text, t.joins, coalesce(skipped, 0) as skipped, t.joins > 0 as live from ty{k} t left join sk{k} using (file_id))"""


_SPLIT_REPAIR = f"""{_MERGES}, lex2 as materialized {_lexicon()}, rates2 as ({_RATES.replace("with ", "select * from (with ", 1)} select * from rates)),
tg as materialized (select f.file_id, f.text, r.splitpair as sp0 from files f join rates2 r using (file_id) where r.splitpair >= 5 and {_CJK} <= 0.05),
{_tokens_of("tg", "dk")},
dr as (select *, sum(starts::int) over (partition by file_id order by i) as run from (select *, length(tok) > 1 or before <> ' ' or lag(length(tok), 1, 9) over (partition by file_id order by i) > 1 as starts from dk)),
dw as (select file_id, run, count(*) as n, lower(string_agg(tok, '' order by i)) as word, max(i) as last from dr where length(tok) = 1 group by file_id, run),
dd as (select file_id, run, last from dw join fr on fr.w = word where n >= 4 and fr.tf >= 20),
dj as (select d.*, dd.run is not null and i < last as joins from dr d left join dd using (file_id, run)),
{_put_together("dj", "dt", "tg")}, rn as (select file_id, count(*) as runs from dd group by file_id),
tx0 as materialized (select file_id, text, true as live from dt), {", ".join(map(_repair_pass, range(1, 5)))},
done as materialized (select g.file_id, tx4.text, tx1.joins + tx2.joins + tx3.joins + tx4.joins as merged, coalesce(runs, 0) as runs, tx1.skipped + tx2.skipped + tx3.skipped + tx4.skipped as skipped, 0::bigint as hyph, tx4.text <> g.text as changed, sp0
    from tg g join tx1 using (file_id) join tx2 using (file_id) join tx3 using (file_id) join tx4 using (file_id) left join rn using (file_id)),
hits1 as (select p.file_id, count(*) as hits from {_pairs("done")} p join lex2 j on j.w = p.a || p.b left join lex2 x on x.w = p.a left join lex2 y on y.w = p.b
    where length(p.a || p.b) >= 5 and j.tf >= 30 and j.tf > 3 * greatest(coalesce(x.tf, 0), coalesce(y.tf, 0)) group by p.file_id)
select d.file_id, {_md5("text")}, merged, runs, skipped, hyph, changed, merged > 0 as would_write, sp0, case when len({_tokens()}) >= 300 then coalesce(hits, 0) / greatest(len({_tokens()}), 1)::double * 1000 end as sp1, n.n as sources, n.n < 20 as few
    from done d left join hits1 using (file_id), n"""

_CHUNK_RUNS = "len(regexp_extract_all({c}, '[A-Za-z0-9+/]{{40,}}={{0,2}}'))"
_UPTO = "regexp_extract(c, '(?s)^.*[0-9+/]')"
_BASE64_RUNS = rf"""list_sum(list_transform(string_split(text, ' '), lambda c: case when {_UPTO} = '' then 0 else {_CHUNK_RUNS.format(c="c")} - {_CHUNK_RUNS.format(c=f"c[length({_UPTO}) + 1:]")} + regexp_matches(c[length({_UPTO}) + 1:], '^[A-Za-z0-9+/]{{40,}}')::int end))"""


def _unglue_targets(omnibus: bool) -> str:
    excluded = "when starts_with(replace(rel, chr(92), '/'), 'omnibus') then 'excluded'" if omnibus else ""
    return f"""(select *, case when {_votes(GERMAN_VOTE)} > {_votes(ENGLISH_VOTE)} then 'german' when len(t) < 300 then 'small' {excluded} when {_BASE64_RUNS} >= 20 then 'base64' end as skip_reason
        from (select *, {_GLUE} as glue from (select *, {_tokens()} as t from files)) where glue >= 3 and {_CJK} <= 0.05)"""


_PIECES = f"""{_CLEAN_GLUE}, fr as materialized {_frequencies("clean")}, n as (select greatest(count(*), 1)::double as n from clean), lex as (select w, tf, df, df / n as share from fr, n),
halves as (select w from lex where share >= 0.55), cuts as (select w, w[1:k] as a, w[k + 1:] as b from (select w, unnest(range(2, length(w) - 1)) as k from lex where share < 0.35 and length(w) >= 4)),
glued as (select distinct w from cuts where a in (from halves) and b in (from halves)), m as (select *, w in (from glued) as glued from lex),
pieces as materialized (select *, length(w) >= 3 and share >= 0.06 and not glued as piece, tf >= 5 or df >= 3 as keep from m)"""
_UNGLUED = f"""{_PIECES.replace("with ", "with recursive ", 1)}, total as (select sum(tf)::double as s from pieces), logs as materialized (select w, ln(tf / s) as p from pieces, total where piece),
tg as materialized (select file_id, text, glue as glue0 from {_unglue_targets(False)} where skip_reason is null),
{_tokens_of("tg", "tk")}, open_ as materialized (select distinct tok as w from tk where length(tok) >= 15 and lower(tok) not in (select w from pieces where keep)),
spans as (select o.w, b, b + k as e, p from (select w, unnest(range(0, length(w))) as b from open_) o cross join (select unnest(range(3, 23)) as k) join logs l on l.w = lower(o.w[b + 1:b + k]) where b + k <= length(o.w)),
given as materialized (select w, list({{'b': b, 'e': e, 'p': p}} order by b) as sp from spans group by w),
dp as (select w, 0 as e, [0.0::double] as best, [0::bigint] as back from given union all
    select w, e + 1, list_append(best, (c).s), list_append(back, (c).b) from (select d.w, e, best, back, list_reduce(list_transform(list_filter(sp, lambda x: x.e = e + 1 and best[x.b + 1] is not null), lambda x: {{'s': best[x.b + 1] + x.p - 8.0, 'b': x.b::bigint}}), lambda x, y: case when x.s is null or y.s > x.s then y else x end, {{'s': null::double, 'b': null::bigint}}) as c from dp d join given using (w) where e < length(d.w))),
ends as (select w, best, back from dp where e = length(w) and best[length(w) + 1] is not null),
path as (select w, back, length(w)::bigint as ix, []::varchar[] as parts from ends union all select w, back, back[ix + 1], list_prepend(w[back[ix + 1] + 1:ix], parts) from path where ix > 0),
cut as materialized (select o.w, case when len(parts) > 1 then array_to_string(parts, ' ') end as cut from open_ o left join (select w, parts from path where ix = 0) using (w)),
wk as (select t.file_id, front, i, coalesce(cut, tok) as tok, sep, false as joins, cut is not null as is_cut, cut.w is not null and cut is null as is_kept from tk t left join cut on cut.w = tok),
{_put_together("wk", "tx", "tg")}, counts as (select file_id, sum(is_cut::int)::bigint as cut, sum(is_kept::int)::bigint as kept from wk group by file_id)
select file_id, {_md5("text")}, cut, kept, changed, glue1, glue0, sources, sources < 20 as few from (select tx.file_id, tx.text, c.cut, c.kept, tx.text <> g.text as changed, glue0, {_GLUE.replace("len(t)", "len(t1)").replace("list_filter(t,", "list_filter(t1,")} as glue1 from (select *, {_tokens()} as t1 from tx) tx join tg g using (file_id) join counts c using (file_id)), (select count(*) as sources from clean)"""

_PLAIN = r"regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{L}\p{N}]', '.', 'g'), '[^\x00-\x7F]', '_', 'g')"


def _ladder_step(k: int, source: str, pattern: str, joins: str, hyphen: str = "false") -> str:
    """One step over fresh texts: what the pattern finds, looked at in one go since a substitution's places don't hang on it."""
    return rf"""m{k} as materialized (select file_id, text, string_split_regex(plain, '{pattern}') as bt, regexp_extract_all(plain, '{pattern}') as mt from (select file_id, text, {_PLAIN} as plain from {source})),
u{k} as materialized (select file_id, text, unnest(list_transform(bt, lambda x: length(x))) as bl, unnest(list_append(mt, null)) as whole, generate_subscripts(bt, 1) as i from m{k}),
v{k} as (select *, regexp_extract(whole, '^[A-Za-z]+') as a, regexp_extract(whole, '[a-z]+$') as b, sum(bl + coalesce(length(whole), 0)) over (partition by file_id order by i) - coalesce(length(whole), 0) - bl as start from u{k}),
l{k} as materialized (select file_id, string_agg(substr(text, start::bigint + 1, bl) || case when whole is null then '' when {joins} then a || b when {hyphen} then a || '-' || b else whole end, '' order by i) as text
    from (select v.*, coalesce(j.tf, 0) as n, coalesce(x.tf, 0) as ta, coalesce(y.tf, 0) as tb, coalesce(o.n, 0) as h from v{k} v left join lex j on j.w = lower(a || b) left join lex x on x.w = lower(a) left join lex y on y.w = lower(b) left join own o on o.file_id = v.file_id and o.h = lower(a || '-' || b)) group by file_id)"""


def _ladder_pass(k: int) -> str:
    return ", ".join((
        _ladder_step(4 * k + 1, f"l{4 * k}", r"[A-Za-z]{2,}-\n[a-z]{2,}", "n >= 50 and n > 3 * h", "h >= 3 and 3 * h > n"),
        _ladder_step(4 * k + 2, f"l{4 * k + 1}", r"[A-Za-z]{2,}\n[a-z]{2,}", "n >= 30 and n > 8 * tb"),
        rf"l{4 * k + 3} as materialized (select file_id, regexp_replace(text, '[ \t]{{2,}}', ' ', 'g') as text from l{4 * k + 2})",
        _ladder_step(4 * k + 4, f"l{4 * k + 3}", r"\b[A-Za-z]{2,}[ ][a-z]{2,}\b", "n >= 50 and n > 20 * tb and n > 3 * ta"),
    ))


def _sp(source: str, name: str) -> str:
    return f"""{name}_h as (select p.file_id, count(*) as hits from {_pairs(source)} p join lex j on j.w = p.a || p.b left join lex x on x.w = p.a left join lex y on y.w = p.b
    where length(p.a || p.b) >= 5 and j.tf >= 30 and j.tf > 3 * greatest(coalesce(x.tf, 0), coalesce(y.tf, 0)) group by p.file_id),
{name} as (select f.file_id, f.text, len({_tokens()}) as words, case when len({_tokens()}) >= 300 then coalesce(hits, 0) / greatest(len({_tokens()}), 1)::double * 1000 end as sp, len(regexp_extract_all({_PLAIN}, '(?i)\\bthe\\b')) as the from {source} f left join {name}_h using (file_id))"""


_LADDER = f"""with {_files()}, lex as materialized {_lexicon()}, old_ as materialized (select file_id, any_value(replace(text, chr(13) || chr(10), chr(10))) as text from wordsplit_damaged group by file_id having any_value(text) is not null),
l0 as materialized (select file_id - 3000000 as file_id, any_value(replace(text, chr(13) || chr(10), chr(10))) as text from glued_damaged group by file_id having any_value(text) is not null),
own as materialized (select file_id, h, count(*) as n from (select file_id, lower(unnest(regexp_extract_all({_PLAIN}, '\\b[A-Za-z]{{2,}}-[A-Za-z]{{2,}}\\b'))) as h from l0) group by all),
{", ".join(map(_ladder_pass, range(4)))}, {_sp("old_", "o")}, {_sp("l16", "w")},
r as (select o.file_id, o.words as words0, o.sp as sp0, o.the as the0, regexp_matches(o.text[1:3000], '[\\x{{4E00}}-\\x{{9FFF}}]') as cjk, w.text, w.the as the1, w.words as words1, w.sp as sp1,
    coalesce(w.sp < 5 and w.sp < o.sp and w.words >= o.words * 0.85 and w.the >= o.the * 0.9, false) as good from o left join w using (file_id)),
ladder as (select *, case when text is null then 'nopdf' when cjk then 'reocr' when good then 'done' else 'reocr' end as status, case when cjk then 'CJK file' when text is null then 'no PDF' when not good then 'still split after re-extraction' end as why from r)"""

_HEADED = """headed as materialized (select file_id, array_to_string(list_transform(range(0, ceil(length(text) / 500)::bigint), lambda i: (i + 1) || ' THE RUNNING HEAD ' || text[i * 500 + 1:i * 500 + 500] || chr(10)), '') as text from files where length(text) > 0),
even as materialized (select file_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as text from headed)"""


def _hits(kind: int, pattern: str) -> str:
    return rf"""(select file_id, {kind} as kind, sum(bl + coalesce(length(whole), 0)) over (partition by file_id order by i) - coalesce(length(whole), 0) as pos, regexp_extract(whole, '\d+')::int as page from
    (select file_id, unnest(list_transform(bt, lambda x: length(x))) as bl, unnest(list_append(mt, null)) as whole, generate_subscripts(bt, 1) as i from (select file_id, string_split_regex(plain, '{pattern}') as bt, regexp_extract_all(plain, '{pattern}') as mt from (select file_id, {_PLAIN} as plain from even))) qualify whole is not null)"""


_ANCHORS = rf"""with recursive {_files("healthy")}, {_HEADED},
hits as materialized (select file_id, pos::bigint as pos, page, row_number() over f - 1 as ix, count(*) over (partition by file_id) as raw, {" and ".join(f"lead(page, {k}) over f < lead(page, {k + 1}) over f" for k in range(5))} and lead(page, 5) over f - page <= 12 as begins from ({_hits(0, r"\b[0-9]{1,3}\s+THE RUNNING HEAD")} union all {_hits(1, r"THE RUNNING HEAD\s+[0-9]{1,3}\b")}) window f as (partition by file_id order by pos, page)),
cutoff as (select file_id, coalesce(min(ix) filter (begins), 0) as dropped from hits group by file_id),
body as materialized (select file_id, any_value(raw) as raw, any_value(dropped) as dropped, list(pos order by ix) as pos, list(page order by ix) as page from hits join cutoff using (file_id) where ix >= dropped group by file_id),
lis as (select file_id, 0 as i, []::int[] as tops, []::int[] as ends, []::int[] as back from body union all
    select file_id, i + 1, tops[:k] || [v] || tops[k + 2:], ends[:k] || [i] || ends[k + 2:], list_append(back, case when k > 0 then ends[k] else -1 end) from (select l.*, b.page[i + 1] as v, len(list_filter(tops, lambda x: x < b.page[i + 1])) as k from lis l join body b using (file_id) where i < len(b.page))),
last as (select l.file_id, ends[-1] as ix, back from lis l join body b using (file_id) where i = len(b.page)),
way as (select * from last union all select file_id, back[ix + 1], back from way where back[ix + 1] >= 0),
kept as materialized (select file_id, pos[ix + 1] as pos, page[ix + 1] as page, raw, dropped from way join body using (file_id)),
steps as (select *, page - lag(page) over f as dp, pos - lag(pos) over f as dx from kept window f as (partition by file_id order by pos, page)),
gate as (select file_id, count(*) as kept, max(raw) as raw, max(dropped) as dropped, count(*) / (max(page) - min(page) + 1)::double as coverage, coalesce(min(dp) > 0, true) as pages_rise, coalesce(min(dx) > 0, true) as places_rise, coalesce(corr(pos::double, page::double), 0) as c, coalesce(max(dp), 0) as gap from steps group by file_id),
gates as (select * exclude (c), case when isnan(c) then 0 else c end as corr, kept >= 8 and pages_rise and places_rise and c > 0.999 and gap <= 6 as passed from gate)"""

_FONTS = """fonts as (select 'scan-' || file_id || '.pdf' as f, case when file_id % 3 > 0 and (page % 4 > 0 or file_id % 3 = 1) then 'GlyphLessFont' else 'Garamond' end as font, length(array_to_string(words, '')) as chars, case when page % 50 = 0 then 'broken' end as err
    from (select file_id, page, any_value(words) as words from pages_a where words is not null group by file_id, page)),
layers as (select f, 9 as pages, case when max(err) is null then coalesce(sum(chars) filter (font = 'Garamond'), 0) / greatest(sum(chars), 1)::double * 100 end as other_pct, max(err) as err, bool_or(font = 'GlyphLessFont') as hidden from fonts group by f)"""

_NUMBER = "('0x' || substr(md5(file_id || ':' || {i} || ':' || {seed}), 1, 8))::bigint"
_DAMAGED = rf"""with {_files("healthy")}, px as (select file_id, unnest(p) as piece, generate_subscripts(p, 1) - 1 as i from (select file_id, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+') as p from files where text is not null)),
cut as (select *, regexp_full_match(piece, '[A-Za-z]{{6,}}') and {_NUMBER.format(i="i", seed=42)} % 1000000 < 70000 as hit, case when {_NUMBER.format(i="i", seed=43)} % 1000000 < 300000 then 1 else 3 + {_NUMBER.format(i="i", seed=44)} % greatest(least(5, length(piece) - 2) - 2, 1) end as k from px),
split as (select file_id, string_agg(case when hit then piece[:k] || ' ' || piece[k + 1:] else piece end, '' order by i) as split from cut group by file_id),
gs as (select file_id, unnest(string_split_regex(text, '(?:[A-Za-z]+ ){{2,3}}[A-Za-z]+')) as between_, unnest(list_append(regexp_extract_all(text, '(?:[A-Za-z]+ ){{2,3}}[A-Za-z]+'), null)) as span, generate_subscripts(string_split_regex(text, '(?:[A-Za-z]+ ){{2,3}}[A-Za-z]+'), 1) - 1 as i from files where text is not null),
glued as (select file_id, string_agg(between_ || coalesce(case when length(replace(span, ' ', '')) >= 18 and {_NUMBER.format(i="i", seed=43)} % 1000000 < 50000 then replace(span, ' ', '') else span end, ''), '' order by i) as glued from gs group by file_id)
select f.file_id, md5(coalesce(split, '')) as split, md5(glued) as glued from files f join glued using (file_id) left join split using (file_id)"""

_PAGE = r"={3,}\s*page\s+\d+\s*={3,}"

_PROBE = rf"""(select *, case when words = 0 then 'en' when fr >= greatest(en, de) then 'fr' when de >= greatest(en, fr) then 'de' else 'en' end as lang from (select doc_id, length(text) as chars, len(t) as words, len(regexp_extract_all(left(text, 100000), '[\x00-\x08\x0B\x0E-\x1F]')) / greatest(least(length(text), 100000), 1)::double * 100 as ctrl_pct,
    len(list_filter(t, lambda x: length(x) = 1)) / greatest(len(t), 1)::double * 100 as single_pct, {_votes(ENGLISH)} as en, {_votes(FRENCH)} as fr, {_votes(GERMAN)} as de
    from (select doc_id, text, list_transform(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'), lambda x: lower(x)) as t from {{source}} where text is not null)))"""

def _normal(text: str = "text") -> str:
    """The texts of the test tables as functions.text.normalise has them: DuckDB decomposes accents, and what else these tables
    hold is full-width signs, spaces, ligatures and apostrophes."""
    wide, plain = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
    spaces = "".join(map(chr, (0xA0, 0x2007, 0x2008, 0x2009, 0x200A, 0x202F, 0x3000)))
    out = f"translate({text}, '{wide}{spaces}', '{plain}{' ' * len(spaces)}')"
    for glyph, letters in (*LIGATURES[:5], ("…", "...")):
        out = f"replace({out}, '{glyph}', '{letters}')"
    return f"translate(strip_accents({out}), '{APOSTROPHES}', '{chr(39) * 2 * len(APOSTROPHES)}')"


_NORMAL_WORD = "[A-Za-z][A-Za-z'']*"
_BARE = "rtrim({w}, '''')"

SQL = {
    "lexicon_df_normal": f"""with {_files("healthy")} select w, count(*) as df from (select distinct file_id, {_BARE.format(w="lower(w)")} as w from (select file_id, unnest(regexp_extract_all({_normal()}, '{_NORMAL_WORD}')) as w from files where text is not null)) group by w""",
    "words_and_separators": f"""with {_files("wordsplit_damaged")}, x as (select file_id, regexp_extract_all(t, '{_NORMAL_WORD}') as w, string_split_regex(t, '{_NORMAL_WORD}') as b from (select file_id, {_normal()} as t from files where text is not null))
        select file_id, len(w) as words, md5(array_to_string(list_transform(range(1, len(w) + 1), lambda i: {_BARE.format(w="w[i]")} || '|' || case when i = len(w) then '' else b[i + 1] end), chr(2))) as digest from x""",
    "glue_rate": f"""select *, coalesce(glue >= 3 and not german and cjk <= 0.05, false) as red from (select doc_id, len(t) as tokens, len(list_filter(t, lambda x: length(x) >= 18)) as long_tokens, {_GLUE} as glue,
        {_votes(GERMAN_VOTE)} > {_votes(ENGLISH_VOTE)} as german, {_CJK} as cjk from (select doc_id, text, {_tokens()} as t from documents where text is not null))""",
    "phrase_density": f"select doc_id, {_PHRASES} as phrases, ({_PHRASES}) / greatest(len({_tokens()}), 1)::double * 10000 as density from documents where text is not null",
    "accent_misreads": f"select *, coalesce(ratio > 50, false) as red from (select doc_id, {_GOOD} as good, {_BAD} as bad, case when {_GOOD} + {_BAD} >= 5 then ({_BAD}) / ({_GOOD} + {_BAD})::double * 100 end as ratio from documents where text is not null)",
    "page_anchor_gate": f"select doc_id, {_ANCHOR} as page_ok from documents where text is not null",
    "health_rows": f"{_HEALTH} select * from flags",
    "health_verdict": f"""{_HEALTH}, sums as (select count(*) as files, coalesce(sum(gate1::int), 0)::bigint as gate1, coalesce(sum(gate2::int), 0)::bigint as gate2, coalesce(sum(gate4::int), 0)::bigint as gate4, coalesce(sum(gate5::int), 0)::bigint as gate5, coalesce(sum(gate6::int), 0)::bigint as gate6 from flags)
        select *, gate1 + gate2 + gate4 + gate5 + gate6 as findings, case when gate1 + gate2 + gate4 + gate5 + gate6 > 0 then 'FINDINGS' else 'ALL GREEN' end as result from sums""",
    "health_report": f"{_HEALTH} select file_id, sp from flags where gate5 order by sp desc, file_id limit 15",
    "garble_rate": f"with {_GARBLE} select * from g",
    "garble_calibration": f"""with {_GARBLE}, ranked as (select rate * 1000 as r, row_number() over (order by rate) as k, count(*) over () as n from g where rate > 0)
        select count(*) as files, coalesce(sum((rate > 0)::int), 0)::bigint as nonzero, coalesce(sum((rate > 0)::int), 0) / greatest(count(*), 1)::double * 100 as nonzero_pct, coalesce(sum(cid::int), 0)::bigint as cid_files,
        coalesce((select max(r) from ranked where k = n // 2 + 1), 0) as median, coalesce((select max(r) from ranked where k = least(floor(n * 0.9), n - 1) + 1), 0) as p90, coalesce((select max(r) from ranked), 0) as max from g""",
    "probe": f"select doc_id, chars, words, ctrl_pct, single_pct, en, fr, de, lang from {_PROBE.format(source='documents')}",
    "pdf_risk": rf"""with t as (select doc_id, case when doc_id % 13 = 0 then text || repeat(chr(1), (length(text) // 50)::bigint) when doc_id % 17 = 0 then regexp_replace(text, '([A-Za-z])', '\1 ', 'g') else text end as text from documents),
        r as (select *, chars / (1 + doc_id % 20)::double as cpp, case when ctrl_pct > 0.5 then ['1'] else [] end || case when single_pct > 30 then ['2'] else [] end || case when doc_id % 7 = 0 or doc_id % 11 = 0 then ['3'] else [] end as three from {_PROBE.format(source='t')})
        select doc_id, case when cpp < 200 then '5' when len(three) > 0 then array_to_string(three, ',') when doc_id % 12 >= 11 * 0.7 and cpp > 800 then '4' else '6' end as findings from r""",
    "lexicon_tf": f"select * from {_lexicon('documents')}",
    "lexicon_top": f"select * from {_lexicon('documents')} order by tf desc, w limit 50",
    "lexicon_tf_df": f"with {_files('healthy')} select * from {_frequencies('files')}",
    "split_rate": f"{_RATES} select * from rates",
    "clean_for_splits": f"{_CLEAN_SPLITS} select file_id from clean",
    "clean_for_glue": f"{_CLEAN_GLUE} select file_id from clean",
    "hyphen_lexicons": f"with {_HYPHENS} select 'plain' as kind, w, tf from plain union all select 'hyphenated', w, tf from hyph",
    "ligatures": f"select doc_id, length(x) as chars, md5(x) as digest from (select doc_id, {_ligatures()} as x from documents where regexp_matches(text, '[{''.join(g for g, _ in LIGATURES)}{DROPPED_GLYPH}]'))",
    "joined_lines": rf"""with {_files("wordsplit_damaged")}, pages as (select file_id, unnest(string_split_regex(text, '\n?\f\n?')) as page, generate_subscripts(string_split_regex(text, '\n?\f\n?'), 1) as i from files where text is not null),
        by_page as (select file_id, string_agg({_line_joined("page")}, chr(12) order by i) as by_page from pages group by file_id)
        select file_id, md5({_line_joined("text")}) as whole, md5(by_page) as by_page from files join by_page using (file_id)""",
    "hyphen_sites": f"with {_SITES} select file_id, pos, a, b, plain_tf, hyphen_tf, verdict from judged",
    "hyphen_totals": f"with {_SITES} select verdict, count(*) as n, count(*) / sum(count(*)) over ()::double * 100 as pct from judged group by verdict",
    "dehyphenated": rf"""with {_SITES}, put as (select file_id, list(case verdict when 'JOIN' then a || b when 'HYPH' then a || '-' || b else site end order by pos) as r, count(*) filter (verdict = 'JOIN') as j, count(*) filter (verdict = 'HYPH') as h, count(*) filter (verdict = 'SKIP') as s from judged group by file_id),
        bt as (select file_id, string_split_regex(text, '[A-Za-z]{{2,}}-\r?\n[a-z]{{2,}}') as bt from files where text is not null)
        select file_id, md5(array_to_string(list_transform(range(1, len(bt) + 1), lambda i: bt[i] || coalesce(r[i], '')), '')) as text, coalesce(j + h > 0, false) as changed, coalesce(j, 0) as "join", coalesce(h, 0) as hyph, coalesce(s, 0) as skip from bt left join put using (file_id)""",
    "dehyphenation_report": f"""with {_SITES}, put as (select file_id, count(*) filter (verdict = 'JOIN') as "join", count(*) filter (verdict = 'HYPH') as hyph, count(*) filter (verdict = 'SKIP') as skip from judged group by file_id)
        select * from put where "join" + hyph > 0 order by "join" + hyph desc, file_id limit 8""",
    "pair_walk": _WALK,
    "pair_walk_fixpoint": _FIXPOINT,
    "pair_walk_consuming": _CONSUMING,
    "merge_table": f"{_MERGES} select * from merges",
    "split_targets": f"{_RATES} select file_id, splitpair from rates join files using (file_id) where splitpair >= 5 and {_CJK} <= 0.05",
    "split_targets_named": f"{_RATES} select file_id, splitpair from rates join files using (file_id) where splitpair is not null and (contains(lower(rel), 'omnibus') or contains(lower(rel), '-1')) and {_CJK} <= 0.05",
    "split_repair": _SPLIT_REPAIR,
    "unglue_targets": f"with {_files()} select file_id, glue, skip_reason from {_unglue_targets(True)}",
    "unglued": _UNGLUED,
    "reextraction": f"{_LADDER} select file_id, words0, sp0, the0, cjk, md5(text) as text, the1, words1, sp1, status, why from ladder",
    "reocr_queue": f"{_LADDER} select 'scan-' || file_id as rel, status, round(sp0, 2) as sp0, round(sp1, 2) as sp1, why from ladder",
    "piece_lexicon": f"{_PIECES} select * from pieces",
    "page_texts": rf"""with {_files()}, p as (select file_id, regexp_extract_all(text, '(?i)={{3,}}\s*page\s+(\d+)\s*={{3,}}', 1) as n, string_split_regex(text, '(?i){_PAGE}') as t from files),
        u as (select file_id, unnest(n)::int as page, generate_subscripts(n, 1) as i, t from p), l as (select file_id, page, max_by(t[i + 1], i) as text from u group by file_id, page)
        select file_id, page, md5(regexp_replace(text, '(?m:<!--.*?-->|^#{{1,6}}\s|^\s*\|.*\|\s*$|\]\((?:https?://|www\.)[^)]*\))', ' ', 'g')) as text from l""",
    "page_words": rf"""with {_files("healthy")}, p as (select file_id, list_concat([null], regexp_extract_all(text, '(?m)^=+\s*page\s+(\d+)\s*=+\s*$', 1)) as n, string_split_regex(text, '(?m)^=+\s*page\s+\d+\s*=+\s*$') as t from files where text is not null),
        u as (select file_id, unnest(n)::int as page, unnest(t) as t, generate_subscripts(t, 1) - 1 as ord from p) select file_id, ord, page, len({_tokens(text="t")}) as words, md5(array_to_string({_tokens(text="t")}, ' ')) as digest from u""",
    "recovered_anchors": f"{_ANCHORS} select * from gates",
    "anchored_texts": f"""{_ANCHORS}, marks as (select file_id, list({{'pos': pos, 'page': page}} order by pos, page) as m from kept where file_id in (select file_id from gates where passed) group by file_id)
        select file_id, md5(text[:m[1].pos] || array_to_string(list_transform(range(1, len(m) + 1), lambda i: chr(10) || '===== page ' || m[i].page || ' =====' || chr(10) || text[m[i].pos + 1:coalesce(m[i + 1].pos, length(text))]), '')) as text from even join marks using (file_id)""",
    "damaged_on_purpose": _DAMAGED,
    "hidden_layers": f"""{_HEALTH.replace(_files(), _files("healthy"))}, {_FONTS}
        select f, pages, other_pct, other_pct > 15 as dual, err, phrase, case when err is not null then 'warn' when not coalesce(other_pct > 15, false) then 'single' when coalesce(phrase >= m * 0.5, false) then 'ok' else 'red' end as state
        from layers left join flags on f = 'scan-' || flags.file_id || '.pdf', med where hidden or err is not null""",
    "health_registry": f"""with {_files()}, b as (select file_id, {_tokens()} as t from files where length(text) >= 2000)
        select file_id, len(t) as words, len(list_filter(t, lambda x: x in ('interpolation', 'sprachgeschichte', 'ecclesiastical'))) as glue_x,
        case when len(t) >= 300 then len(list_filter(t, lambda x: length(x) >= 13 and x not in ('interpolation', 'sprachgeschichte', 'ecclesiastical'))) / len(t)::double * 1000 end as glue from b""",
    "garble_report": f"with {_GARBLE} select doc_id, rate from g where flagged order by rate desc, doc_id limit 40",
    "separators": rf"""with {_files("wordsplit_damaged")}, x as (select unnest(list_filter(string_split_regex(text, '[A-Za-z]+'), lambda x: x <> '')) as sep from files where text is not null)
        select {_SEP_OK} as ok, contains({_SAME_SEP}, '-') as hyphen, count(*) as n from x group by all""",
    "heads_and_piece": rf"""with {_files()}, x as (select file_id, text, '(?mi)^[ \t]*\d*[ \t]*(?:the catalogue|on catalogues|le catalogue)[ \t]*\d*[ \t]*$' as pat, instr(text, 'the ') - 1 as i, instr(text, ' of') - 1 as j from files where text is not null)
        select file_id, md5(regexp_replace(text, pat, '', 'g')) as rest, len(regexp_extract_all(text, pat)) as heads, case when i >= 0 and j > i then md5(text[i + 1:j + 3]) end as piece, i >= 0 and j > i as cut from x""",
    "non_words": f"select * from {_non_words('wordsplit_damaged')}",
    "switch_decisions": f"""with j as (select l.file_id, l.words as layer_words, l.bad as layer_bad, o.words as ocr_words, o.bad as ocr_bad from {_non_words('wordsplit_damaged')} l join {_non_words('glued_damaged')} o on o.file_id - 3000000 = l.file_id),
        r as (select *, case when least(layer_words, ocr_words) >= 200 then layer_bad / layer_words::double * 100 end as layer_pct, case when least(layer_words, ocr_words) >= 200 then ocr_bad / ocr_words::double * 100 end as ocr_pct from j)
        select *, case when layer_pct is null then 'too few' when layer_pct - ocr_pct >= 1 and (layer_pct - ocr_pct) / greatest(layer_pct, 1e-9) >= 0.15 then 'switch' else 'keep' end as verdict from r""",
}
