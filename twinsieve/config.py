"""Parameters of a detection run, and presets for known relations."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class DetectConfig:
    """Everything that a run depends on; attributes are named by 0-based column place or by column name."""

    algorithm: str = "PSNM"  # PSNM, PB or NONE
    use_profiler: bool = True
    filter_missing: bool = True
    filter_fd: bool = True
    filter_pk: bool = True
    filter_ind: bool = True
    use_weights: bool = True
    use_fd: bool = True
    use_ucc: bool = True
    window_size: int = 20
    window_interval: int = 1
    block_size: int = 4
    max_block_range: int = 4
    similarity_threshold: float = 0.65
    null_threshold: float = 0.05
    max_fd_determinant: int = 3
    max_ucc_determinant: int = 3
    similarity_attributes: tuple[int | str, ...] = ()
    #: Column whose values must differ within a pair (two sources in one relation).
    two_in_one: int | str | None = None
    sind_threshold: float = 0.75
    gpdep_threshold: float = 0.0
    max_attributes: int = 100
    max_value_length: int = 200
    interlaced_key_length: int = 100
    measurement_interval: int = 50
    quality_horizon: int = 2000
    separator: str = ";"
    header: bool = True
    encoding: str = "ISO-8859-1"

    def but(self, **changes: object) -> DetectConfig:
        return replace(self, **changes)


#: The presets' thresholds, limits and attributes.
PRESETS = {
    "CD": DetectConfig(similarity_threshold=0.65, null_threshold=0.05, max_fd_determinant=2, similarity_attributes=(2, 3, 8, 9)),
    "CENSUS": DetectConfig(similarity_threshold=0.75, null_threshold=0.25, similarity_attributes=(1, 5), measurement_interval=1, quality_horizon=15),
    "CORA": DetectConfig(window_size=200, max_block_range=60, similarity_threshold=0.65, null_threshold=0.1, max_fd_determinant=5, similarity_attributes=(3, 15), quality_horizon=3000),
    "DBLP_SCHOLAR": DetectConfig(similarity_threshold=0.65, null_threshold=0.05, similarity_attributes=(1, 4), two_in_one=2, quality_horizon=1800),
    "NCVOTERS": DetectConfig(similarity_threshold=0.5, null_threshold=0.15, similarity_attributes=(26, 31, 47), measurement_interval=20, quality_horizon=800),
    "NCVOTERS_SAMPLE": DetectConfig(similarity_threshold=0.55, null_threshold=0.25, max_ucc_determinant=5, similarity_attributes=(26, 31, 47), measurement_interval=1, quality_horizon=60),
}
