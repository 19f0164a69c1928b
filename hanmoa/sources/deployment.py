"""The deployment configuration: weights by environment with an A/B policy, and the JSON file that holds it."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime

from hanmoa.operators.similarity import Weights

ENVIRONMENTS = ("development", "staging", "production")
DEFAULT_SALT = "hanmoa-ab"


class MissingEnvironment(KeyError):
    pass


class MissingFile(FileNotFoundError):
    pass


@dataclass(frozen=True)
class Policy:
    enabled: bool = False
    ratio: float = 0.0
    salt: str = DEFAULT_SALT


@dataclass(frozen=True)
class Environment:
    control: Weights = field(default_factory=Weights)
    treatment: Weights | None = None
    policy: Policy = field(default_factory=Policy)

    def sanitized(self, default: Environment | None = None) -> Environment:
        """Weights and ratio within limits, a salt that isn't blank; without treatment weights or switched off the ratio is 0."""
        salt = self.policy.salt if self.policy.salt.strip() else (default or Environment()).policy.salt
        enabled = self.policy.enabled and self.treatment is not None
        ratio = min(1.0, max(0.0, self.policy.ratio)) if enabled else 0.0
        return Environment(self.control.sanitized(), self.treatment and self.treatment.sanitized(), Policy(enabled, ratio, salt))


def _defaults() -> dict[str, Environment]:
    w = Weights()
    return {"development": Environment(w, w, Policy(True, 1.0, "dev")), "staging": Environment(w, w, Policy(True, 0.5, "staging")), "production": Environment()}


@dataclass(frozen=True)
class Config:
    version: int = 1
    model: str = "v1"
    updated: datetime = field(default_factory=lambda: datetime.now(UTC).replace(microsecond=0))
    environments: dict[str, Environment] = field(default_factory=_defaults)

    def sanitized(self) -> Config:
        """Values that can't be are replaced by the defaults, and missing environments filled in."""
        plain = Config()
        given = {k: e.sanitized(plain.environments.get(k)) for k, e in self.environments.items()}
        return Config(
            self.version if self.version > 0 else plain.version,
            self.model if self.model.strip() else plain.model,
            self.updated if self.updated.timestamp() > 0 else plain.updated,
            plain.environments | given,
        )


def bucket_of(environment: Environment, user: str | None, forced: str | None = None) -> str:
    """control or treatment, as ``feedback.ab_bucket`` has it for a column of users."""
    has, p = environment.treatment is not None, environment.policy
    if forced is not None:
        return "treatment" if forced == "treatment" and has else "control"
    ratio = min(1.0, max(0.0, p.ratio))
    if not p.enabled or not has or ratio <= 0:
        return "control"
    if ratio >= 1:
        return "treatment"
    if not user:
        return "control"
    h = 14695981039346656037
    for b in f"{p.salt}|{user}".encode():
        h = (h ^ b) * 1099511628211 % 2**64
    return "treatment" if h % 10_000 / 10_000 < ratio else "control"


def resolve(config: Config, environment: str, user: str | None, forced: str | None = None) -> tuple[str, str, Weights]:
    """(environment, bucket, weights) of a user."""
    if environment not in config.environments:
        raise MissingEnvironment(environment)
    e = config.environments[environment]
    bucket = bucket_of(e, user, forced)
    return environment, bucket, (e.treatment or e.control) if bucket == "treatment" else e.control


def resolve_or_default(config: Config, environment: str, user: str | None, forced: str | None = None) -> tuple[str, str, Weights]:
    """As ``resolve`` of the sanitized configuration, of production if the environment is missing."""
    good = config.sanitized()
    return resolve(good, environment if environment in good.environments else "production", user, forced)


def _environment(d: dict) -> Environment:
    return Environment(Weights(**d["control"]), Weights(**d["treatment"]) if d.get("treatment") else None, Policy(**d["policy"]))


def save(config: Config, path: str) -> None:
    """Writes the file whole or not at all, with sorted keys and ISO dates; makes missing folders."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    data = asdict(config) | {"updated": config.updated.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")}
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(data, f, indent=2, sort_keys=True, ensure_ascii=False)
    os.replace(f.name, path)


def load(path: str) -> Config:
    """Environments may be an object or a list of keys and values in turn."""
    if not os.path.exists(path):
        raise MissingFile(path)
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    e = d["environments"]
    if isinstance(e, list):
        e = dict(zip(e[::2], e[1::2], strict=True))
    return Config(d["version"], d["model"], datetime.fromisoformat(d["updated"]), {k: _environment(v) for k, v in e.items()})


def load_or_default(path: str) -> Config:
    """The sanitized configuration, or the default if the file is missing or broken."""
    try:
        return load(path).sanitized()
    except (OSError, ValueError, KeyError, TypeError):
        return Config().sanitized()


def load_if_exists(path: str) -> Config | None:
    return load(path).sanitized() if os.path.exists(path) else None


def with_weights(config: Config, environment: str, bucket: str, weights: Weights, model: str, now: datetime) -> Config:
    """The configuration with a bucket's weights replaced; a treatment that was off gets at least a twentieth of users."""
    e = config.environments[environment]
    if bucket == "control":
        e = replace(e, control=weights)
    else:
        p = e.policy if e.policy.enabled else replace(e.policy, enabled=True, ratio=max(0.05, e.policy.ratio))
        e = replace(e, treatment=weights, policy=p)
    return replace(config, environments=config.environments | {environment: e}, updated=now, model=model)
