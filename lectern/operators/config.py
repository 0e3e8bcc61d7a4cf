"""Settings of chunking, synthesis, mastering and rendering."""

from __future__ import annotations

from dataclasses import dataclass, field

MAX_CHARS = 250


@dataclass(frozen=True)
class SynthConfig:
    temperature: float = 0.4
    max_attempts: int = 3
    words_per_second: float = 2.5
    headroom: float = 1.6
    headroom_s: float = 2.0
    least_cap_s: float = 4.0
    floor_wps: float = 4.5
    ceiling_s: float = 1.5
    ceiling_word_s: float = 0.75
    sentence_gap_s: float = 0.12
    split_sentences: bool = True
    spell_acronyms: bool = False
    rising: str | None = None  # name of a policy: "yes_no_question"
    rise_semitones: float = 1.5
    lexicon: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class MasterConfig:
    loudness_lufs: float = -16.0
    ceiling_db: float = -1.0
    highpass_hz: float = 75.0
    channels: int = 2

    def __post_init__(self) -> None:
        if self.channels not in (1, 2):
            raise ValueError("channels must be 1 or 2")


@dataclass(frozen=True)
class RenderConfig:
    max_chars: int = MAX_CHARS
    synth: SynthConfig = field(default_factory=SynthConfig)
    master: MasterConfig = field(default_factory=MasterConfig)
    quarantine: bool = True
    reroll: frozenset[int] = frozenset()
