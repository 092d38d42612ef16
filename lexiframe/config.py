"""Fixed values and run settings."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from hashlib import sha256

# Special symbols; their position is their vocabulary id.
SPECIAL_WORDS = ["<UNK>", "<EOS>", "<PAD>", "<GO>"]
UNK, EOS, PAD, GO = 0, 1, 2, 3

# Character symbols (start, end, filler) before the letters.
CHAR_START, CHAR_END, CHAR_PAD = "S", "E", "P"
LETTERS = "abcdefghijklmnopqrstuvwxyz"

# The common English stop word list. Entries with an apostrophe
# never match a cleaned word, their fragments do.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your "
    "yours yourself yourselves he him his himself she she's her hers herself it "
    "it's its itself they them their theirs themselves what which who whom this "
    "that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't "
    "didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma "
    "mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't "
    "wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Experiment name layout and the pattern that reads it back.
EXPERIMENT_FORMAT = "%s_cell_%s_dir_%s_bat_%d_maxlen_%d_unit_%d_layer_%d"
EXPERIMENT_PATTERN = (
    "^(.*)_cell_(.*)_dir_(.*)_bat_([0-9]+)_maxlen_([0-9]+)"
    "_unit_([0-9]+)_layer_([0-9]+)_epoch_([0-9]+)_([0-9]+)"
)
EXPERIMENT_FIELDS = [
    ("inf_mode", "string"),
    ("cell_type", "string"),
    ("rnn_direction", "string"),
    ("batch_size", "int"),
    ("sentence_length", "int"),
    ("num_unit", "int"),
    ("num_layer", "int"),
    ("epoch", "int"),
    ("run_time", "long"),
]
REPORT_METRICS = ["accuracy", "precision", "recall", "f_measure"]

MODES = ("self", "next")

# Environment names of the run settings.
ENVIRONMENT = {
    "INFERENCE_MODE": ("mode", str),
    "BATCH_SIZE": ("batch_size", int),
    "MAX_SENTENCE_LENGTH": ("max_len", int),
    "EVAL_GAP": ("eval_gap", int),
}


@dataclass(frozen=True)
class Settings:
    """Data-facing settings with their usual defaults."""

    mode: str = "next"
    batch_size: int = 256
    max_len: int = 30
    eval_gap: int = 10
    min_count: int = 20
    window: int = 10
    sample: float = 1e-3
    negative: int = 10
    seed: int = 1

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}, expected one of {MODES}")
        if self.batch_size < 1 or self.max_len < 1:
            raise ValueError("batch_size and max_len must be positive")

    @classmethod
    def from_environment(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """Settings given in the environment, the defaults for the rest."""
        return cls(**{field: kind(env[name]) for name, (field, kind) in ENVIRONMENT.items()
                      if name in env})

    def fingerprint(self, *extra: object) -> str:
        """Short key of these settings; `extra` adds inputs a step depends on."""
        text = repr(sorted(asdict(self).items())) + repr(extra)
        return sha256(text.encode()).hexdigest()[:16]
