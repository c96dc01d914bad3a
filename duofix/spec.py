"""What a panel is and what is asked of it; typed refusals."""

from __future__ import annotations

from dataclasses import dataclass, field

PHYSICAL_LIMIT = 1 << 53

HINTS = {
    "MATCH_INPUT_MISSING": "a deletion unit holds a missing value; drop the unit or fill it",
    "INVALID_FREQUENCY": "frequency weights must be positive whole numbers",
    "INVALID_TARGET": "target weights must not be negative and must have a positive sum",
    "CROSS_COORDINATE_MATCH": "each deletion id must stay with one worker and one firm",
    "WORKER_COLLISION": "two workers have the same 64-bit hash; number the workers",
    "PHYSICAL_TOTAL_LIMIT": "the sum of frequencies exceeds 2^53",
    "NO_LEAVEOUT_COMPONENT": "no connected sample is left after pruning",
    "AMBIGUOUS_LARGEST_COMPONENT": "two components tie for the largest; restrict the sample",
    "EXACT_LIMIT": "too many firms and controls for the exact algorithm",
    "NONESTIMABLE_UNIT": "a deletion unit has leverage 1",
    "RANK_DEFICIENT_CONTROLS": "controls are collinear with the effects or one another",
    "INFERENCE_MODEL_REMOVED": "this variance model is no longer offered",
    "CENTERING_UNIT": "use centering='mean', or drop the unit",
    "RANK_DEFICIENT_PROJECTION": "the covariates of the projection are collinear with one another or the constant",
    "PROJECTION_COVARIANCE": "the estimated covariance of the projection isn't positive; use fewer covariates or more units",
    "INFERENCE_VARIANCE_INVALID": "the unit variances can't be estimated on this sample",
    "INTERVALS_NOT_NORMAL": "an interval comes from a leading direction, so there is no joint covariance; inference='highrank' gives one",
    "TARGET_IDENTITY_FAILED": "the kernels don't reproduce the estimates; check the conditioning of the panel",
    "FIRM_VECTORS": "lower the number of probes or of controls; the driver holds one number a firm for each",
    "NOT_CONVERGED": "raise maxiter, or drop weakly connected firms",
    "INVALID_OPTION": "see the list of options",
}


class Withheld(Exception):
    """Nothing is reported: status tells why."""

    def __init__(self, status: str, detail: str = ""):
        super().__init__(f"{status}: {detail or HINTS.get(status, '')}")
        self.status, self.detail, self.hint = status, detail, HINTS.get(status, "")


@dataclass(frozen=True)
class PanelSpec:
    """Roles of columns and options. unit: deletion id (default: the worker-firm cell).

    algorithm auto is exact up to exact_limit firms and controls, else jla (random probes, conjugate gradients).
    """

    y: str
    worker: str
    firm: str
    unit: str | None = None
    frequency: str | None = None
    target: str | None = None
    controls: tuple[str, ...] = ()
    factors: tuple[str, ...] = field(default=())
    deletion: str = "match"
    stayers: str = "both"
    centering: str = "mean"
    nuisance: str = "joint"
    algorithm: str = "auto"
    exact_limit: int = 2000
    probes: int = 200
    seed: int = 8675309
    tolerance: float = 1e-10
    maxiter: int = 10_000
    firm_cells: int = 100_000_000
    inference: str = "auto"
    inference_model: str = "repeat"
    inference_draws: int = 8
    inference_seed: int = 1
    level: float = 95.0
    project: tuple[str, ...] = ()
    project_effect: str = "firm"
    project_weight: str = "frequency"

    def validate(self) -> PanelSpec:
        for name, allowed in (("deletion", ("match", "observation")), ("stayers", ("movers", "both")), ("centering", ("none", "mean", "corrected")), ("nuisance", ("joint", "fixed_offset")), ("algorithm", ("auto", "exact", "jla")), ("inference", ("auto", "none", "highrank", "q1")), ("project_effect", ("worker", "firm")), ("project_weight", ("frequency", "target"))):
            if getattr(self, name) not in allowed:
                raise Withheld("INVALID_OPTION", f"{name}={getattr(self, name)!r}: one of {', '.join(allowed)}")
        if self.inference_model in ("target_lowess", "structured_common", "structured_leverage"):
            raise Withheld("INFERENCE_MODEL_REMOVED", self.inference_model)
        if len(self.controls) > 32:
            raise Withheld("INVALID_OPTION", "at most 32 controls")
        if self.inference_draws < 1 or not 0 < self.level < 100:
            raise Withheld("INVALID_OPTION", "inference_draws from 1, level between 0 and 100")
        if self.probes < 2:
            raise Withheld("INVALID_OPTION", "at least two probes")
        return self
