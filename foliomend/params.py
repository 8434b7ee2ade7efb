"""Thresholds of all operators, with the defaults of the method this engine follows."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class JoinStep:
    """A step of the repair of a fresh extraction: what pattern finds becomes one word if the joined form occurs `least` times
    and more than so many times as often as its first part, its second part and the text's own hyphenated form; it keeps its
    hyphen if that form occurs `keep` times and the joined one isn't so much more frequent. Without least, a space."""

    pattern: str
    least: int | None = None
    over_first: int = 0
    over_second: int = 0
    over_hyphenated: int = 0
    keep: int = 0


@dataclass(frozen=True)
class Params:
    # health rows and gates
    min_chars: int = 20_000
    phrase_dead: float = 0.15
    phrase_clean: float = 0.5
    accent_evidence: int = 5
    accent_red: float = 50.0
    cjk_limit: float = 0.05
    glue_letters: int = 18
    glue_tokens: int = 300
    glue_red: float = 3.0
    glue_clean: float = 1.5
    split_letters: int = 5
    split_tf: int = 30
    split_ratio: float = 3.0
    split_tokens: int = 1500
    split_red: float = 5.0
    split_clean: float = 2.0
    garble_flag: float = 0.1
    # split repair
    word_df: float = 0.06
    merge_tf: int = 20
    overwhelm: float = 10.0
    display_run: int = 4
    max_separator: int = 4
    repair_passes: int = 4
    repair_tokens: int = 500
    # unglue
    unglue_letters: int = 15
    min_piece: int = 3
    max_piece: int = 22
    piece_penalty: float = 8.0
    pair_own_df: float = 0.35
    pair_half_df: float = 0.55
    keep_tf: int = 5
    keep_df: int = 3
    unglue_tokens: int = 2000
    base64_runs: int = 20
    # dehyphenation
    join_tf: int = 3
    join_ratio: float = 2.0
    hyphen_tf: int = 2
    # re-extraction
    accept_words: float = 0.85
    accept_the: float = 0.9
    cjk_head: int = 3000
    ladder_passes: int = 4
    # fixed values: a hyphen at a line's end, a soft line break, blanks, a space within a line
    ladder: tuple[JoinStep, ...] = (
        JoinStep(r"([A-Za-z]{2,})-\n([a-z]{2,})", 50, over_hyphenated=3, keep=3),
        JoinStep(r"([A-Za-z]{2,})\n([a-z]{2,})", 30, over_second=8),
        JoinStep(r"[ \t]{2,}"),
        JoinStep(r"\b([A-Za-z]{2,})[ ]([a-z]{2,})\b", 50, over_first=3, over_second=20),
    )
    # page anchors
    anchors_least: int = 8
    toc_run: int = 6
    toc_span: int = 12
    anchor_corr: float = 0.999
    anchor_gap: int = 6
    # second witness
    max_sub: int = 3
    ratio: int = 8
    common_df: int = 20
    bad_df: int = 2
    run_words: int = 6
    join_df_ratio: int = 4
    coverage: float = 0.8
    furniture_pages: int = 3
    furniture_letters: int = 24
    prose_share: float = 0.2
    length_ratio: tuple[float, float] = (0.85, 1.15)
    # scan layer against a new recognition
    switch_points: float = 1.0
    switch_relative: float = 0.15
    switch_words: int = 200
    # small corpora, from which nothing should be learned without a look
    sources_repair: int = 20
    sources_witness: int = 200
    # hidden layers of a PDF
    dual_percent: float = 15.0
    # risk of a PDF
    image_chars: int = 200
    control_percent: float = 0.5
    control_head: int = 100_000
    single_percent: float = 30.0
    image_share: float = 0.7
    image_page_chars: int = 800


DEFAULTS = Params()
