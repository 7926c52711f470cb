"""Fixed values of the risk rules, and the profile object that carries them.

Everything in the "fixed values" block must equal the behaviour being
reproduced; it is stated once, plainly, and every rule reads it from here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must match the reproduced behaviour exactly)
# ---------------------------------------------------------------------------

# Risk keyword list used by the caption-level percent score (18 entries).
KEYWORDS_V1 = (
    "kill myself", "kys", "suicide", "end it all", "cutting", "self harm",
    "self-harm", "depressed", "depression", "worthless", "i wanna die",
    "i want to die", "cant do this", "can't do this", "hopeless", "alone",
    "nobody cares", "no one cares",
)

# Risk keyword list used by the post-level text risk (23 entries).
KEYWORDS_V2 = (
    "kill myself", "kys", "suicide", "end it all", "cutting", "self harm",
    "self-harm", "depressed", "depression", "worthless", "i wanna die",
    "i want to die", "can't do this", "cant do this", "hopeless", "alone",
    "nobody cares", "no one cares", "help me", "save me", "hate myself",
    "why am i alive", "i give up",
)

# Base text risk by hashtag (lower-cased, not trimmed); anything else -> 0.20.
TAG_BASE_RISK = (
    ("depression", 0.53),
    ("anxiety", 0.43),
    ("suicide", 0.73),
    ("psychosis", 0.63),
)
TAG_BASE_DEFAULT = 0.20

# Hashtags that add a 0.15 bonus to the caption-level percent score.
BONUS_TAGS = ("suicide", "killmyself", "selfharm", "self_harm")
BONUS_TAG_VALUE = 0.15

# Keyword boost by number of distinct hits: 0, 1, 2, >=3.
KEYWORD_BOOST = (0.0, 0.15, 0.25, 0.40)

# Sentiment adjustment of the base risk.
SENTIMENT_ADJUST_NEG = 0.10
SENTIMENT_ADJUST_POS = -0.05

# Level thresholds (>= HIGH, >= MEDIUM, else LOW).
LEVEL_HIGH = 0.70
LEVEL_MEDIUM = 0.40

# Face-emotion base risk; anything else (including missing) -> 0.4.
EMOTION_HIGH = ("sad", "fear", "angry", "disgust")
EMOTION_HIGH_VALUE = 0.7
EMOTION_NEUTRAL_VALUE = 0.4
EMOTION_HAPPY_VALUE = 0.15
EMOTION_OTHER_VALUE = 0.4
FACE_PERCENT_CUTOFF = 1.5  # scores above this are read as percent

# No-face (atmosphere) video risk weights and defaults.
VISUAL_W_SAD = 0.45
VISUAL_W_ANGRY = 0.25
VISUAL_W_DULL = 0.20
VISUAL_W_MOTION = 0.10
VISUAL_BRIGHT_SCALE = 255.0
VISUAL_MOTION_SCALE = 20.0
VISUAL_DEFAULT_BRIGHTNESS = 128.0

# Multimodal fusion weights: text, random forest, video.
FUSION_W_TEXT = 0.45
FUSION_W_RF = 0.35
FUSION_W_VIDEO = 0.20

# Random-forest class probabilities -> score.
RF_W_LOW = 0.1
RF_W_MEDIUM = 0.5
RF_W_HIGH = 1.0

# Caption-level percent score weights.
PCT_W_NEG = 0.5
PCT_W_KEYWORD = 0.3
PCT_W_ENGAGEMENT = 0.2
ENGAGEMENT_SCALE = 100_000.0

# Documented alternative final risk: .6 neg + .2 neu + 0 pos + .15 per hit.
DOC_W_NEG = 0.6
DOC_W_NEU = 0.2
DOC_W_POS = 0.0
DOC_W_HIT = 0.15

# Comment label -> risk.
COMMENT_LABEL_RISK = (("NEG", 1.0), ("NEU", 0.5), ("POS", 0.0))
COMMENT_EMPTY_RISK = 0.2
MAX_COMMENTS_PER_VIDEO = 20
VIDEOS_PER_HASHTAG = 3

# Atmosphere scores from frame statistics.
ATMOS_SAD_DARK_W = 0.6
ATMOS_SAD_BLUR_W = 0.4
ATMOS_BLUR_CUTOFF = 20.0
ATMOS_ANGRY_SCALE = 50.0

# Class labels: alphabetical order is the encoder order (HIGH=0, LOW=1, MEDIUM=2).
LEVELS = ("HIGH", "LOW", "MEDIUM")
SENTIMENT_LABELS = ("NEG", "NEU", "POS")
SENTIMENT_WORDS = ("negative", "neutral", "positive")

# Text length a training row must exceed; minimum usable training rows.
MIN_TEXT_CHARS = 10
MIN_TRAIN_ROWS = 100
SUMMARY_CHARS = 300

# Label-column priority for training, and text columns used when present.
LABEL_PRIORITY = ("true_label", "mm_risk_level", "risk_level_v2", "rf_risk_label")
TRAIN_TEXT_COLS = ("caption", "transcript", "summary")

# TF-IDF settings of the two trainers.
V1_MAX_FEATURES = 5000
V1_TREES = 300
V2_WORD_MAX_FEATURES = 60000
V2_CHAR_MAX_FEATURES = 80000
V2_WORD_MAX_DF = 0.95
V2_CHAR_MAX_DF = 0.98
V2_MIN_DF = 2
V2_TREES = 800
SPLIT_TEST_SHARE = 0.2
SPLIT_SEED = 42

# ---------------------------------------------------------------------------
# Our own stand-in sentiment lexicon (not from the reproduced behaviour):
# single lower-case words, matched as whole tokens, each counted once.
# ---------------------------------------------------------------------------
LEXICON_NEGATIVE = (
    "sad", "hopeless", "alone", "lonely", "worthless", "depressed", "depression",
    "hate", "pain", "cry", "crying", "hurt", "tired", "afraid", "scared",
    "anxiety", "panic", "suicide", "kill", "harm", "cutting", "empty",
    "miserable", "broken", "nobody", "awful", "terrible", "bad",
)
LEXICON_POSITIVE = (
    "happy", "great", "amazing", "love", "good", "awesome", "wonderful", "fun",
    "best", "joy", "glad", "beautiful", "excited", "lol", "hahaha", "nice",
    "calm", "hope",
)
LEXICON_PRIOR = 2.0  # pseudo-count that goes to "neutral"


@dataclass(frozen=True)
class RiskProfile:
    """Parameters of the rule set; the defaults reproduce the reference."""

    keywords_v1: tuple = KEYWORDS_V1
    keywords_v2: tuple = KEYWORDS_V2
    tag_base: tuple = TAG_BASE_RISK
    tag_default: float = TAG_BASE_DEFAULT
    bonus_tags: tuple = BONUS_TAGS
    missing_video: str = "reference"  # or "neutral"
    lexicon_negative: tuple = LEXICON_NEGATIVE
    lexicon_positive: tuple = LEXICON_POSITIVE
    max_comments: int = MAX_COMMENTS_PER_VIDEO
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.missing_video not in ("reference", "neutral"):
            raise ValueError("missing_video must be 'reference' or 'neutral'")


DEFAULT_PROFILE = RiskProfile()
