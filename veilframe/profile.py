"""The subject profile: validated on the driver, turned into literals there."""

from __future__ import annotations

import re
from pathlib import Path
from typing import Annotated, Any

import yaml
from pydantic import BaseModel, BeforeValidator, Field, ValidationError, field_validator
from pyspark.sql import DataFrame, SparkSession

from veilframe import model
from veilframe.errors import ProfileError

#: A YAML key with comments only is null; it stands for no entries.
Listed = BeforeValidator(lambda v: [] if v is None else v)
Strings = Annotated[list[str], Listed]


class AccountNumber(BaseModel):
    value: str
    preserve_last: int = Field(4, ge=0, le=16)


class CustomPattern(BaseModel):
    name: str
    regex: str

    @field_validator("regex")
    @classmethod
    def compiles(cls, v: str) -> str:
        try:
            re.compile(v)
        except re.error as e:
            raise ValueError(f"regex does not compile: {e}") from e
        return v


class Subject(BaseModel):
    display_name: str
    aliases: Strings = []
    addresses: Strings = []
    phones: Strings = []
    emails: Strings = []
    ssns: Strings = []
    account_numbers: Annotated[list[AccountNumber], Listed] = []
    custom_patterns: Annotated[list[CustomPattern], Listed] = []

    @field_validator("display_name")
    @classmethod
    def named(cls, v: str) -> str:
        if not v.strip():
            raise ValueError("display_name is blank")
        return v


class Settings(BaseModel):
    """fuzzy_match, ocr_fallback and scan_figures are accepted and, as in the reference, change nothing."""

    use_presidio: bool = False
    presidio_entities: Strings = []
    fuzzy_match: bool = True
    match_threshold: float = Field(0.85, ge=0, le=1)
    full_token_min_length: int = Field(2, ge=1)
    ocr_fallback: bool = True
    column_aware: bool = True
    scan_figures: bool = False
    address_line_bridge_window: int = Field(3, ge=0, le=10)


class Profile(BaseModel):
    version: int = 1
    name: str = ""
    subject: Subject
    detection: Settings = Settings()

    @field_validator("version")
    @classmethod
    def known(cls, v: int) -> int:
        if v != 1:
            raise ValueError(f"version {v} is not known")
        return v


def parse_profile(data: Any) -> Profile:
    if not isinstance(data, dict):
        raise ProfileError("a profile is a mapping at its top")
    try:
        return Profile.model_validate(data)
    except ValidationError as e:
        raise ProfileError(str(e)) from e


def load_profile(path: str | Path) -> Profile:
    path = Path(path)
    if not path.exists():
        raise ProfileError(f"no profile at {path}")
    try:
        data = yaml.safe_load(path.read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise ProfileError(f"{path} is no YAML: {e}") from e
    return parse_profile(data)


def save_profile(profile: Profile, path: str | Path) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump(profile.model_dump(), allow_unicode=True, sort_keys=False), encoding="utf-8")


def template(display_name: str = "") -> str:
    """A profile in YAML with every key and its default, to be filled in."""
    empty = Profile.model_construct(subject=Subject.model_construct(display_name=display_name), detection=Settings())
    notes = {"display_name": "required", "account_numbers": "items of value and preserve_last", "custom_patterns": "items of name and regex", "match_threshold": "0 to 1; lower finds more"}
    lines = yaml.safe_dump(empty.model_dump(), sort_keys=False, allow_unicode=True).splitlines()
    return "\n".join(f"{x}  # {notes[k]}" if (k := x.strip().split(":")[0]) in notes else x for x in lines) + "\n"


def profile_frame(spark: SparkSession, profile: Profile) -> DataFrame:
    """The profile as one row."""
    return spark.createDataFrame([profile.model_dump()], model.PROFILE)


def mask_value(value: str, keep: int = 4) -> str:
    return value if len(value) <= keep else "*" * (len(value) - keep) + value[-keep:]


def mask_name(name: str) -> str:
    return " ".join(p[0] + "***" if len(p) > 1 else p for p in name.split())


def mask_profile(profile: Profile) -> dict:
    """The profile for display. Aliases are masked like the name."""
    out = profile.model_dump()
    subject = out["subject"]
    subject["display_name"] = mask_name(subject["display_name"])
    subject["aliases"] = [mask_name(a) for a in subject["aliases"]]
    for key in ("phones", "emails", "ssns", "addresses"):
        subject[key] = [mask_value(v) for v in subject[key]]
    for account in subject["account_numbers"]:
        account["value"] = mask_value(account["value"])
    return out


def name_terms(profile: Profile) -> list[str]:
    """The display name and aliases that have a token of the least length, in order."""
    s, least = profile.subject, profile.detection.full_token_min_length
    return [t for t in [s.display_name, *s.aliases] if any(len(w) >= least for w in re.findall(r"\w+", t.lower()))]


def ocr_terms(profile: Profile) -> list[str]:
    """What recognised words are compared with: words of the names, and the other values whole."""
    s = profile.subject
    words = [w for n in [s.display_name, *s.aliases] for w in n.split()]
    values = [*words, *s.phones, *s.emails, *s.ssns, *(a.value for a in s.account_numbers)]
    return sorted({v.strip().lower() for v in values if v.strip()})
