"""Repairs of texts: line-end hyphens, split words, display words, glued words, and the acceptance of a fresh extraction.

Nothing is changed in place: each operator gives a new text and says whether it differs. Lexicons stay relations; what a text's
own repair needs of them is worked out once for each distinct pair or word, and looked up by operators.lookup.resolved."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomend.functions import text as T
from foliomend.operators import lexicon as L
from foliomend.operators.lookup import Look, resolved
from foliomend.params import DEFAULTS, JoinStep, Params
from foliomend.runtime import BROADCAST_ROWS, filled, small_side, stored

_TOKEN = re.compile(r"[A-Za-z]+")

# -- line-end hyphens, by expressions alone -----------------------------------------------------------------------------

# Fixed value: a word cut at a line's end.
SITE = r"([A-Za-z]{2,})-\r?\n([a-z]{2,})"


def hyphen_verdict(plain: Column, hyphenated: Column, params: Params = DEFAULTS) -> Column:
    """JOIN where the joined form is attested enough, HYPH where the hyphenated one is, else SKIP."""
    join = (plain >= params.join_tf) & (plain > params.join_ratio * hyphenated)
    return F.when(join, "JOIN").when((hyphenated >= params.hyphen_tf) & (hyphenated > plain), "HYPH").otherwise("SKIP")


def hyphen_sites(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pos, site, a, b of each word cut at a line's end, in order from 0."""
    found = F.regexp_extract_all(F.col(text), F.lit(SITE), F.lit(0))
    sites = docs.select(F.col(key), F.posexplode(found).alias("pos", "site"))
    return sites.withColumn("a", F.regexp_extract("site", "^[A-Za-z]+", 0)).withColumn("b", F.regexp_extract("site", "[a-z]+$", 0))


def judged_sites(sites: DataFrame, plain: DataFrame, hyphenated: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """sites with plain_tf, hyphen_tf and verdict. Each distinct pair is judged once."""
    pairs = sites.select(F.lower("a").alias("__a"), F.lower("b").alias("__b")).distinct()
    p = plain.select(F.col("w").alias("__w"), F.col("tf").alias("plain_tf"))
    h = hyphenated.select(F.col("h").alias("__h"), F.col("tf").alias("hyphen_tf"))
    pairs = pairs.withColumn("__w", F.concat("__a", "__b")).withColumn("__h", F.concat_ws("-", "__a", "__b"))
    pairs = stored(pairs.join(p, "__w", "left").join(h, "__h", "left").fillna(0, ["plain_tf", "hyphen_tf"]).drop("__w", "__h"))
    pairs = pairs.withColumn("verdict", hyphen_verdict(F.col("plain_tf"), F.col("hyphen_tf"), params))
    known = small_side(pairs, pairs.count())
    on = (F.lower(F.col("a")) == F.col("__a")) & (F.lower(F.col("b")) == F.col("__b"))
    return sites.join(known, on).drop("__a", "__b")


def hyphen_totals(judged: DataFrame) -> DataFrame:
    """verdict, n and pct of all sites."""
    totals = judged.groupBy("verdict").agg(F.count("*").alias("n"))
    grand = totals.agg(F.sum("n").alias("all"))
    return totals.join(grand, F.lit(True), "inner").select("verdict", "n", (T.share(F.col("n"), F.col("all")) * 100).alias("pct"))


def dehyphenated(docs: DataFrame, judged: DataFrame, key: str, text: str = "text", limit: int = BROADCAST_ROWS) -> DataFrame:
    """key, text, changed, join, hyph and skip of each row of docs: sites judged JOIN become ab, HYPH a-b, the line break going in
    both, and the numbers of sites by verdict. Texts stay in their rows; the distinct pairs' verdicts are looked up. Null texts
    stay null."""
    verdicts = judged.where("verdict <> 'SKIP'").select(F.concat_ws("-", F.lower("a"), F.lower("b")).alias("name"), "verdict").distinct()
    site = re.compile(SITE)

    def kernel(text: str, look: Look) -> dict:
        n = Counter()

        def put(m: re.Match) -> str:
            verdict = (look(f"{m[1]}-{m[2]}".lower()) or ("SKIP",))[0]
            n[verdict] += 1
            return {"JOIN": m[1] + m[2], "HYPH": f"{m[1]}-{m[2]}", "SKIP": m[0]}[verdict]

        new = site.sub(put, text)
        return {"text": new, "changed": n["JOIN"] + n["HYPH"] > 0, "join": n["JOIN"], "hyph": n["HYPH"], "skip": n["SKIP"]}

    out = resolved(docs, key, text, verdicts, kernel, "text string, changed boolean, join bigint, hyph bigint, skip bigint", limit)
    zero = F.lit(0).cast("bigint")
    empty = docs.where(F.col(text).isNull()).select(key, F.lit(None).cast("string").alias("text"), F.lit(False).alias("changed"), zero.alias("join"), zero.alias("hyph"), zero.alias("skip"))
    return out.unionByName(empty)


# -- walks over tokens --------------------------------------------------------------------------------------------------


def walk_pairs(text: str, accept: Callable[[str, str], bool], sep: str = " ", token: re.Pattern = _TOKEN) -> tuple[str, int]:
    """Joins neighbouring tokens that only sep stands between, left to right: after a join both are used up, after a refusal
    only the first is, so that the second may still join with what follows."""
    spans = [m.span() for m in token.finditer(text)]
    keep, last, joins, i = [], 0, 0, 0
    while i + 1 < len(spans):
        (b0, e0), (b1, e1) = spans[i], spans[i + 1]
        if text[e0:b1] == sep and accept(text[b0:e0], text[b1:e1]):
            keep.append(text[last:e0])
            last = b1
            joins += 1
            i += 2
        else:
            i += 1
    return "".join(keep) + text[last:], joins


def walk_to_fixpoint(text: str, accept: Callable[[str, str], bool], sep: str = " ", passes: int = 12) -> tuple[str, int]:
    """walk_pairs until nothing changes, for words in three parts and more; and all joins."""
    total = 0
    for _ in range(passes):
        text, joins = walk_pairs(text, accept, sep)
        total += joins
        if not joins:
            break
    return text, total


def consuming_pairs(text: str, accept: Callable[[str, str], bool], sep: str = " ") -> tuple[str, int]:
    """The counter-example: pairs as a substitution sees them, where a refused pair uses up its second token too."""
    joins = 0

    def put(m: re.Match) -> str:
        nonlocal joins
        if not accept(m[1], m[2]):
            return m[0]
        joins += 1
        return m[1] + m[2]

    return re.sub(rf"([A-Za-z]+){re.escape(sep)}([A-Za-z]+)", put, text), joins


_WALKS = {"once": walk_pairs, "fixpoint": walk_to_fixpoint, "consuming": consuming_pairs}


def joined_pairs(docs: DataFrame, pairs: DataFrame, key: str, text: str = "text", walk: str = "fixpoint", sep: str = " ", limit: int = BROADCAST_ROWS) -> DataFrame:
    """key, text and joins of each row of docs with a text, neighbouring words that are in pairs (a, b, in lower case) with sep
    between them being joined: by one walk (once), by walks until nothing changes (fixpoint), or as a substitution would
    (consuming), which misses what a refused pair uses up."""
    facts = pairs.select(F.concat_ws(" ", "a", "b").alias("name")).distinct()

    def kernel(text: str, look: Look) -> dict:
        new, joins = _WALKS[walk](text, lambda a, b: look(f"{a} {b}".lower()) is not None, sep)
        return {"text": new, "joins": joins}

    return resolved(docs, key, text, facts, kernel, "text string, joins bigint", limit)


_SAME = str.maketrans({**dict.fromkeys(T.HYPHENS, "-"), "\t": " ", "\n": " ", "\r": " "})


def separator_class(separator: str, most: int = 4) -> tuple[bool, bool]:
    """As functions.text.separator_class, for one string."""
    even = re.sub(" +", " ", separator.translate(_SAME))
    return len(separator) <= most and even in (" ", "-", " -", "- "), "-" in even


class SplitRepair:
    """Repair of one text. look("a b") gives, of two parts in lower case whose joined form is attested, whether they may be
    joined, and whether each is a word by itself; None of others."""

    def __init__(self, look: Look, params: Params = DEFAULTS) -> None:
        self.look, self.params = look, params

    def collapse(self, text: str) -> tuple[str, int]:
        """Letters set apart one by one become the word they spell, the whole run at once or not at all."""
        n = 0

        def put(m: re.Match) -> str:
            nonlocal n
            word = m[0].replace(" ", "")
            low = word.lower()
            if self.look(f"{low[:1]} {low[1:]}") is None:
                return m[0]
            n += 1
            return word

        least = self.params.display_run - 1
        return re.sub(rf"(?<![A-Za-z])[A-Za-z](?: [A-Za-z](?![A-Za-z])){{{least},}}", put, text), n

    def once(self, text: str, examples: Counter, left: Counter) -> tuple[str, int]:
        """One walk: the text and how many pairs were joined. examples and left get the pairs that were joined, and the attested
        ones that were left alone."""
        spans = [m.span() for m in _TOKEN.finditer(text)]
        keep, last, merged, i = [], 0, 0, 0
        while i + 1 < len(spans):
            (b0, e0), (b1, e1) = spans[i], spans[i + 1]
            i += 1
            sep = text[e0:b1]
            if not separator_class(sep, self.params.max_separator)[0] or b0 and text[b0 - 1] in "'’":
                continue
            a, b = text[b0:e0], text[b1:e1]
            fact = self.look(f"{a} {b}".lower())
            if fact is None:
                continue
            if fact[0] and not self._guarded(a, b, *fact[1:]):
                keep.append(text[last:e0])
                last = b1
                merged += 1
                i += 1
                examples[f"{a}[{sep.replace(chr(10), '<NL>')}]{b} -> {(a + b).lower()}"] += 1
            else:
                left[f"{a}|{b}"] += 1
        return "".join(keep) + text[last:], merged

    @staticmethod
    def _guarded(a: str, b: str, a_word: bool, b_word: bool) -> bool:
        """A single letter beside a word is an initial or an article; two single letters are what a display word left."""
        if len(b) == 1 and (a_word or len(a) == 1 and (a.isupper() or b.isupper())):
            return True
        return len(a) == 1 and a.isupper() and b_word

    def repair(self, text: str) -> dict:
        new, runs = self.collapse(text)
        merged, examples, left = 0, Counter(), Counter()
        for _ in range(self.params.repair_passes):
            new, n = self.once(new, examples, left)
            merged += n
            if not n:
                break
        # the commonest first, of equal ones what came first; the counts beside them are whole
        tops = {"examples": [k for k, _ in examples.most_common(5)], "left": [k for k, _ in left.most_common(4)]}
        return tops | {"text": new, "merged": merged, "runs": runs, "skipped": sum(left.values()), "hyph": 0, "changed": new != text, "would_write": merged > 0}


def is_word(tf_word: Column, df: Column, sources: Column, params: Params = DEFAULTS) -> Column:
    """Whether a form counts as a word in repairs of splits: a and i of one letter, else spread over enough clean files."""
    return F.when(F.length(tf_word) == 1, tf_word.isin("a", "i")).otherwise(df / F.greatest(sources, F.lit(1)) >= params.word_df)


def merge_table(clean: DataFrame, sources: int, params: Params = DEFAULTS) -> DataFrame:
    """a, b (lower case), mergeable, a_word and b_word of every pair whose joined form is attested: clean (w, tf, df) cut at
    each place. Two words that are words by themselves merge only if the joined form overwhelms the rarer one."""
    joined = clean.where(F.col("tf") >= params.merge_tf)
    cuts = joined.where(F.length("w") > 1).select("tf", "w", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("k"))
    cuts = cuts.select("tf", F.expr("substring(w, 1, k)").alias("a"), F.expr("substring(w, k + 1)").alias("b"))
    side = lambda n: clean.select(F.col("w").alias(n), F.col("tf").alias(f"tf_{n}"), F.col("df").alias(f"df_{n}"))
    both = cuts.join(side("a"), "a", "left").join(side("b"), "b", "left").fillna(0, ["tf_a", "df_a", "tf_b", "df_b"])
    word = lambda n: is_word(F.col(n), F.col(f"df_{n}"), F.lit(sources), params)
    both = both.withColumn("a_word", word("a")).withColumn("b_word", word("b"))
    over = F.col("tf") > params.overwhelm * F.least("tf_a", "tf_b")
    return both.select("a", "b", (~(F.col("a_word") & F.col("b_word")) | over).alias("mergeable"), "a_word", "b_word")


_REPAIRED = "text string, merged bigint, runs bigint, skipped bigint, hyph bigint, changed boolean, would_write boolean, examples array<string>, left array<string>"


def split_facts(table: DataFrame) -> DataFrame:
    """merge_table as facts for SplitRepair."""
    return table.select(F.concat_ws(" ", "a", "b").alias("name"), "mergeable", "a_word", "b_word")


def repair_splits(docs: DataFrame, key: str, text: str = "text", params: Params = DEFAULTS, targets: DataFrame | None = None, limit: int = 4 * BROADCAST_ROWS, measured: DataFrame | None = None) -> DataFrame:
    """key, text, merged, runs, skipped, hyph, changed, would_write, and the commonest joined (examples) and untouched (left) pairs
    of the texts to repair, all of docs or those whose key is in targets. The lexicon is learned from the clean rows of docs
    alone. measured: lexicon.split_measures of docs, if it was made already.

    hyph is always 0: the lexicon holds no hyphenated forms, so that branch can't fire. would_write is false for a text in which
    only display words changed. Null texts give no row, empty ones an unchanged one."""
    measured = stored(L.split_measures(docs, key, text, params)) if measured is None else measured
    clean = stored(L.clean_keys(measured, key, params))
    sources = clean.count()
    clean_docs = docs.where(F.col(text).isNotNull()).join(small_side(clean, sources), key, "left_semi")
    table = merge_table(stored(L.frequencies(clean_docs, text)), sources, params)
    chosen = docs
    if targets is not None:
        keys = stored(targets.select(key).distinct())
        chosen = docs.join(small_side(keys, keys.count()), key, "left_semi")
    return resolved(chosen, key, text, split_facts(table), lambda t, look: SplitRepair(look, params).repair(t), _REPAIRED, limit)


def split_targets(docs: DataFrame, key: str, text: str = "text", names: tuple[str, ...] = (), rel: str = "rel", params: Params = DEFAULTS, measured: DataFrame | None = None) -> DataFrame:
    """key and splitpair of the rows to repair: measurable, little Chinese, and a rate of split_red or more. With names, rows
    whose rel holds one of them in any case, whatever their rate."""
    measured = L.split_measures(docs, key, text, params) if measured is None else measured
    rates = measured.where((F.col("tokens") >= params.repair_tokens) & (F.col("cjk") <= params.cjk_limit)).select(key, (F.col("pairs") / F.greatest("tokens", F.lit(1)) * 1000).alias("splitpair"))
    wanted = [n.strip().lower() for n in names if n.strip()]
    if not wanted:
        return rates.where(F.col("splitpair") >= params.split_red)
    hit = F.lit(False)
    for n in wanted:
        hit = hit | F.contains(F.lower(F.col(rel)), F.lit(n))
    return rates.join(docs.where(hit).select(key), key, "left_semi")


# -- glued words --------------------------------------------------------------------------------------------------------


def piece_lexicon(clean: DataFrame, sources: int, params: Params = DEFAULTS) -> DataFrame:
    """clean (w, tf, df) with share (of the clean files), glued (two very common words in one that is rare itself), piece (fit
    to be a part of a glued word) and keep (never to be cut)."""
    lexicon = clean.withColumn("share", F.col("df") / F.lit(float(max(sources, 1))))
    halves = lexicon.where(F.col("share") >= params.pair_half_df).select("w")
    cuts = lexicon.where(F.col("share") < params.pair_own_df).where(F.length("w") >= 4).select("w", F.explode(F.sequence(F.lit(2), F.length("w") - 2)).alias("k"))
    cuts = cuts.select("w", F.expr("substring(w, 1, k)").alias("a"), F.expr("substring(w, k + 1)").alias("b"))
    glued = cuts.join(halves.withColumnRenamed("w", "a"), "a", "left_semi").join(halves.withColumnRenamed("w", "b"), "b", "left_semi").select("w").distinct()
    marked = lexicon.join(glued.withColumn("glued", F.lit(True)), "w", "left").withColumn("glued", F.coalesce("glued", F.lit(False)))
    piece = (F.length("w") >= params.min_piece) & (F.col("share") >= params.word_df) & ~F.col("glued")
    return marked.withColumn("piece", piece).withColumn("keep", (F.col("tf") >= params.keep_tf) | (F.col("df") >= params.keep_df))


def segment(word: str, log: dict[str, float], params: Params = DEFAULTS) -> list[str] | None:
    """The pieces of a glued word with the highest sum of log probabilities, each piece costing a penalty; of equal ones the
    first found, that is the one with the longest last piece. None for fewer than two pieces. Letters keep their case."""
    low, n = word.lower(), len(word)
    best: list[tuple[float, int] | None] = [(0.0, 0)] + [None] * n
    for end in range(1, n + 1):
        for begin in range(max(0, end - params.max_piece), end):
            if best[begin] is not None and (p := log.get(low[begin:end])) is not None:
                score = best[begin][0] + p - params.piece_penalty
                if best[end] is None or score > best[end][0]:
                    best[end] = score, begin
    if best[n] is None:
        return None
    cuts, at = [n], n
    while at:
        at = best[at][1]
        cuts.append(at)
    cuts.reverse()
    return [word[a:b] for a, b in zip(cuts, cuts[1:])] if len(cuts) > 2 else None


def segments(words: DataFrame, lexicon: DataFrame, params: Params = DEFAULTS, limit: int = BROADCAST_ROWS) -> DataFrame:
    """w and parts (null if it can't be cut) of each distinct word of words. lexicon: piece_lexicon. Pieces are at most 1 /
    word_df times the mean length of a file's vocabulary in number, and are counted before they are sent; if they are too many,
    each word gets those among its substrings by a join."""
    spark = words.sparkSession
    total = lexicon.agg(F.sum("tf").alias("n")).first()["n"] or 1
    pieces = stored(lexicon.where("piece").select("w", F.ln(F.col("tf") / F.lit(float(total))).alias("p")))
    schema = "w string, parts array<string>"
    if pieces.count() <= limit:
        log = spark.sparkContext.broadcast({r["w"]: r["p"] for r in pieces.collect()})

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"w": batch["w"], "parts": [segment(w, log.value, params) for w in batch["w"]]})

        return words.select("w").mapInPandas(filled(run), schema)
    spans = words.select("w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("i")).select("w", "i", F.explode(F.sequence(F.lit(params.min_piece), F.lit(params.max_piece))).alias("n"))
    subs = spans.where("i + n - 1 <= length(w)").select(F.col("w").alias("whole"), F.lower(F.expr("substring(w, i, n)")).alias("w")).distinct()
    given = subs.join(pieces, "w").groupBy("whole").agg(F.collect_list(F.struct("w", "p")).alias("own"))

    def run_own(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"w": batch["w"], "parts": [segment(w, {x["w"]: x["p"] for x in o} if o is not None else {}, params) for w, o in zip(batch["w"], batch["own"])]})

    return words.select("w").join(given.withColumnRenamed("whole", "w"), "w", "left").mapInPandas(filled(run_own), schema)


def unglue_targets(docs: DataFrame, key: str, text: str = "text", excluded: tuple[str, ...] = (), rel: str = "rel", params: Params = DEFAULTS) -> DataFrame:
    """key, glue and skip_reason (german, small, excluded, base64, or null for a text to repair) of the rows whose glue rate is
    glue_red or more and that have little Chinese."""
    t = F.col(text)
    rows = docs.withColumn("glue", L.glue_rate(t, params)).where((F.col("glue") >= params.glue_red) & (T.cjk_share(t) <= params.cjk_limit))
    rows = rows.withColumn("__t", T.lowered(T.tokens(t)))
    low = F.col("__t")
    prefix = F.lit(False)
    for x in excluded:
        prefix = prefix | F.startswith(F.replace(F.col(rel), F.lit("\\"), F.lit("/")), F.lit(x))
    reason = F.when(T.is_german(low), "german").when(F.size(low) < params.unglue_tokens, "small").when(prefix, "excluded").when(T.matches(t, T.BASE64) >= params.base64_runs, "base64")
    return rows.select(F.col(key), "glue", reason.alias("skip_reason"))


def unglue(docs: DataFrame, key: str, text: str = "text", targets: DataFrame | None = None, params: Params = DEFAULTS, limit: int = BROADCAST_ROWS, clean: DataFrame | None = None) -> DataFrame:
    """key, text, cut, kept, changed, and the first cut (examples) and untouched (left) words of the texts to repair (all of docs, or those in targets without a skip_reason): glued
    words of unglue_letters letters or more are cut into words of the clean rows of docs. Each distinct word is cut once. clean:
    the texts (text) of those rows, if they were found already."""
    clean_docs = stored(L.clean_for_glue(docs, text, params).select(F.col(text).alias("text"))) if clean is None else clean
    lexicon = stored(piece_lexicon(stored(L.frequencies(clean_docs)), clean_docs.count(), params))
    chosen = docs
    if targets is not None:
        keys = stored(targets.where("skip_reason is null").select(key).distinct())
        chosen = docs.join(small_side(keys, keys.count()), key, "left_semi")
    chosen = chosen.where(F.col(text).isNotNull())
    long = chosen.select(F.explode(T.tokens(F.col(text), params.unglue_letters)).alias("w")).distinct()
    kept = lexicon.where("keep").select(F.col("w").alias("__w"))
    open_ = long.withColumn("__w", F.lower("w")).join(kept, "__w", "left_anti").select("w")
    facts = segments(open_, lexicon, params, limit).select(F.col("w").alias("name"), F.array_join("parts", " ").alias("cut"))
    token = re.compile(rf"[A-Za-z]{{{params.unglue_letters},}}")

    def kernel(text: str, look: Look) -> dict:
        n, cuts, left = [0, 0], [], []

        def put(m: re.Match) -> str:
            fact = look(m[0])
            if fact is None:
                return m[0]
            n[fact[0] is None] += 1
            (left if fact[0] is None else cuts).append(m[0] if fact[0] is None else f"{m[0]} -> {fact[0]}")
            return fact[0] or m[0]

        new = token.sub(put, text)
        return {"text": new, "cut": n[0], "kept": n[1], "changed": new != text, "examples": cuts[:4], "left": left[:3]}

    return resolved(chosen, key, text, facts, kernel, "text string, cut bigint, kept bigint, changed boolean, examples array<string>, left array<string>", limit)


# -- a fresh extraction -------------------------------------------------------------------------------------------------


def _stepped(text: str, step: JoinStep, tf: Callable[[str], int], own: Counter, walk: bool) -> str:
    """A text after one step. own: the hyphenated forms of the text itself."""
    if step.least is None:
        return re.sub(step.pattern, " ", text)

    def form(a: str, b: str) -> str | None:
        """What two parts become; None for what they were."""
        joined = tf((a + b).lower())
        hyphenated = own[f"{a}-{b}".lower()] if step.over_hyphenated else 0
        rivals = ((step.over_first, a), (step.over_second, b))
        if joined >= step.least and joined > step.over_hyphenated * hyphenated and all(not k or joined > k * tf(part.lower()) for k, part in rivals):
            return a + b
        return f"{a}-{b}" if step.keep and hyphenated >= step.keep and step.over_hyphenated * hyphenated > joined else None

    if walk and step.over_first:
        return walk_pairs(text, lambda a, b: len(a) > 1 < len(b) and b.islower() and form(a, b) is not None)[0]
    return re.sub(step.pattern, lambda m: form(m[1], m[2]) or m[0], text)


def ladder(text: str, tf: Callable[[str], int], walk: bool = False, params: Params = DEFAULTS) -> str:
    """Repairs a fresh extraction by a lexicon, step by step as params.ladder has them, until nothing changes. The last step sees
    pairs as a substitution does, each token in one pair only; with walk, a refused pair gives its second token to the next."""
    own = Counter(w.lower() for w in re.findall(r"\b[A-Za-z]{2,}-[A-Za-z]{2,}\b", text))
    for _ in range(params.ladder_passes):
        before = text
        for step in params.ladder:
            text = _stepped(text, step, tf, own, walk)
        if text == before:
            break
    return text


def least_that_counts(params: Params = DEFAULTS) -> int:
    """The occurrences from which on a word can change what ladder does; rarer ones may as well be missing."""
    steps = [s for s in params.ladder if s.least is not None]
    return ceil(min([s.least / k for s in steps for k in (s.over_first, s.over_second) if k] + [s.keep * s.over_hyphenated for s in steps if s.keep] + [s.least for s in steps]))


def reextracted(docs: DataFrame, fresh: DataFrame, key: str, lexicon: DataFrame, text: str = "text", walk: bool = False, params: Params = DEFAULTS, limit: int = 2 * BROADCAST_ROWS) -> DataFrame:
    """The escalation ladder: for each key of docs its old and new measures, the repaired fresh text and why it is accepted or
    goes on to a new recognition. fresh: key and text of a new extraction; rows without one are `no PDF`, those with Chinese in
    their first cjk_head characters `CJK file`.

    status: done, reocr or nopdf. Accepted are texts below split_red and below what they were, with enough words left, and of
    the word the."""
    the = lambda c: T.matches(c, rf"(?i)(?<![{T._LETTER}])the(?![{T._LETTER}])")
    words = lexicon.where(F.col("tf") >= least_that_counts(params)).select(F.col("w").alias("name"), "tf")

    def kernel(text: str, look: Look) -> dict:
        return {"text": ladder(text, lambda w: (look(w) or (0,))[0], walk, params)}

    crlf = lambda c: F.replace(c, F.lit("\r\n"), F.lit("\n"))
    fixed = stored(resolved(fresh.select(F.col(key), crlf(F.col(text)).alias(text)), key, text, words, kernel, "text string", limit))
    pairs = stored(L.split_pairs(lexicon, params))

    def rates(df: DataFrame, column: str, n: int) -> DataFrame:
        counts = L.split_counts(df, pairs, key, column)
        rate = F.when(F.col("tokens") >= params.split_tokens, F.col("pairs") / F.greatest("tokens", F.lit(1)) * 1000)
        return counts.select(key, F.col("tokens").alias(f"words{n}"), rate.alias(f"sp{n}"))

    old = docs.where(F.col(text).isNotNull()).select(F.col(key), crlf(F.col(text)).alias("__old"))
    out = rates(old, "__old", 0).join(old.select(key, the(F.col("__old")).alias("the0"), F.substring("__old", 1, params.cjk_head).rlike(T.CJK).alias("cjk")), key)
    new = fixed.select(key, "text", the(F.col("text")).alias("the1")).join(rates(fixed, "text", 1), key)
    out = out.join(new, key, "left")
    good = (F.col("sp1") < params.split_red) & (F.col("sp1") < F.col("sp0")) & (F.col("words1") >= F.col("words0") * params.accept_words) & (F.col("the1") >= F.col("the0") * params.accept_the)
    status = F.when(F.col("text").isNull(), "nopdf").when(F.col("cjk"), "reocr").when(F.coalesce(good, F.lit(False)), "done").otherwise("reocr")
    why = F.when(F.col("cjk"), "CJK file").when(F.col("text").isNull(), "no PDF").when(F.coalesce(good, F.lit(False)), F.lit(None)).otherwise("still split after re-extraction")
    return out.withColumn("status", status).withColumn("why", why)
