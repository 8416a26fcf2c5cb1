"""Parameters of a comparison, brought into their ranges."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    ngram: int = 4                    # 2 to 8
    n_out: int = 1                    # 0 to 2
    min_chain_words: int = 2          # at least 1
    fuzz_threshold: float = 0.75      # 0.5 to 1
    similarity_threshold: float = 0.0
    min_shared: int = 3
    max_candidates: int | None = 4000  # None: all candidates go on
    cap_words: int | None = 400       # None: all words of a unit take part
    cap_units: int | None = None      # None: all units take part
    window: int = 140
    overlap: int = 25
    merges: tuple[tuple[str, str], ...] | None = None  # None: words are scored, else their subwords
    merge_limit: int | None = None    # None: all merges; 0: characters
    stop: frozenset[str] = frozenset()  # subwords left out of the scores

    def clamped(self) -> Params:
        return replace(
            self,
            ngram=max(2, min(8, int(self.ngram))), n_out=max(0, min(2, int(self.n_out))),
            min_chain_words=max(1, int(self.min_chain_words)), fuzz_threshold=max(0.5, min(1.0, float(self.fuzz_threshold))),
        )
