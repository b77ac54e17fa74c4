"""Rule documents as users write them (JSON objects or YAML text): checked by path, normalised, and turned into a Rule.

Every issue has a code, a message and the path of what is wrong. Errors make a document invalid; warnings tell what has no
effect yet. A document of another shape is not looked into any further.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from crateflow.operators import rules


@dataclass(frozen=True)
class Issue:
    code: str
    message: str
    path: str | None = None


@dataclass(frozen=True)
class Checked:
    """normalised: the document with every default filled in, if it is valid; rule: what it asks for."""

    errors: list[Issue] = field(default_factory=list)
    warnings: list[Issue] = field(default_factory=list)
    normalised: dict[str, Any] | None = None
    rule: rules.Rule | None = None

    @property
    def valid(self) -> bool:
        return not self.errors


class Wrong(Exception):
    """A value of another kind than asked for."""


def _number(v: Any) -> float:
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise Wrong("a number is expected")
    return float(v)


def _whole(v: Any) -> int:
    if isinstance(v, bool) or not isinstance(v, (int, float)) or v != int(v):
        raise Wrong("a whole number is expected")
    return int(v)


def _text(v: Any) -> str:
    if not isinstance(v, str):
        raise Wrong("a text is expected")
    return v


def _flag(v: Any) -> bool:
    if not isinstance(v, bool):
        raise Wrong("true or false is expected")
    return v


def _or_none(kind: Callable[[Any], Any]) -> Callable[[Any], Any]:
    return lambda v: None if v is None else kind(v)


def _one_of(*names: str) -> Callable[[Any], Any]:
    def kind(v: Any) -> str:
        if v not in names:
            raise Wrong(f"one of {', '.join(names)} is expected")
        return v

    return kind


class ListOf:
    def __init__(self, kind: Callable[[Any], Any]):
        self.kind = kind


class MapOf:
    """An object with any keys, whose values are all of one shape."""

    def __init__(self, kind: Any):
        self.kind = kind


#: A shape is a function of a value, a ListOf, a MapOf, or a dictionary of (shape, default) by key; without a default a key must be there.
NEEDED = object()
_BEHAVIOUR = _or_none(_one_of("warn", "exclude", "skip_and_renormalize"))
_STATUS = (MapOf(ListOf(_text)), None)
#: Keys, kinds, defaults and choices of a rule document.
SHAPE: dict[str, Any] = {
    "name": (_text, NEEDED), "description": (_or_none(_text), None), "target_size": (_whole, 80), "engine_version": (_text, "playlist_engine_v1"),
    "source": ({"liked_tracks": (_flag, False), **{k: (ListOf(_whole), []) for k in ("playlists_include", "playlists_exclude", "track_ids_include", "track_ids_exclude", "clusters_include", "clusters_exclude")}, "seed_tracks": (ListOf(_text), [])}, NEEDED),
    "filters": ({
        "features": (MapOf({"min": (_or_none(_number), None), "max": (_or_none(_number), None), "required": (_flag, False), "unavailable_behavior": (_BEHAVIOUR, None)}), {}), "availability_status": _STATUS, "market_status": _STATUS,
        "exclude_artists": (ListOf(_whole), []), "exclude_albums": (ListOf(_whole), []), "exclude_tags": (ListOf(_text), []),
    }, NEEDED),
    "weights": ({"missing_component_behavior": (_one_of("skip_and_renormalize", "fail"), "skip_and_renormalize"), "components": (MapOf({"weight": (_number, 0.0), "unavailable_behavior": (_BEHAVIOUR, None)}), {})}, NEEDED),
    "constraints": ({
        "max_tracks_per_artist": (_or_none(_whole), None), "max_tracks_per_album": (_or_none(_whole), None), "avoid_duplicate_isrc": (_flag, True), "avoid_same_artist_consecutive": (_flag, False),
        "cluster_diversity": ({"enabled": (_flag, False)}, {}), "vocal_balance": ({"enabled": (_flag, False)}, {}),
    }, NEEDED),
    "ordering": ({"mode": (_text, "score_desc"), "random_seed": (_or_none(_whole), 42)}, NEEDED),
    "spotify": ({"playlist_name": (_text, ""), "visibility": (_one_of("public", "private", "collaborative"), "private"), "sync_mode": (_text, "replace_after_dry_run"), "target_playlist_id": (_or_none(_text), None)}, NEEDED),
}
ORDERINGS = ("score_desc", "score_asc", "recently_added_desc", "recently_added_asc", "artist_grouped", "artist_spread", "random_seeded")


def _fitted(value: Any, shape: Any, path: str, found: list[Issue]) -> Any:
    """value with defaults filled in; what doesn't fit is added to found."""
    try:
        if isinstance(shape, ListOf):
            if not isinstance(value, list):
                raise Wrong("a list is expected")
            return [_fitted(v, shape.kind, f"{path}.{k}", found) for k, v in enumerate(value)]
        if isinstance(shape, (MapOf, dict)):
            if not isinstance(value, Mapping):
                raise Wrong("an object is expected")
            if isinstance(shape, MapOf):
                return {str(k): _fitted(v, shape.kind, f"{path}.{k}" if path else str(k), found) for k, v in value.items()}
            out = {}
            for key, (kind, default) in shape.items():
                where = f"{path}.{key}" if path else key
                if key in value and not (value[key] is None and default is None):
                    out[key] = _fitted(value[key], kind, where, found)
                elif default is NEEDED:
                    found.append(Issue("RULE_INVALID_SCHEMA", "this is required", where))
                else:
                    out[key] = _fitted(default, kind, where, found) if isinstance(kind, dict) else default
            return out
        return shape(value)
    except Wrong as e:
        found.append(Issue("RULE_INVALID_SCHEMA", str(e), path))
        return None


def read(document: Mapping[str, Any] | None = None, text: str | None = None) -> tuple[Any, list[Issue]]:
    """The document of a YAML text, or as given."""
    if text is None:
        return document, []
    try:
        import yaml
    except ImportError:
        return None, [Issue("RULE_INVALID_YAML", "no YAML reader is installed", "rule_yaml")]
    try:
        return yaml.safe_load(text), []
    except yaml.YAMLError as e:
        return None, [Issue("RULE_INVALID_YAML", str(e), "rule_yaml")]


def check(document: Mapping[str, Any] | None = None, text: str | None = None, known: Sequence[str] = (), future: Sequence[str] = ()) -> Checked:
    """A document (or YAML text) against the shape, then against what is known: features by name, and those to come."""
    raw, wrong = read(document, text)
    if wrong:
        return Checked(wrong)
    if not isinstance(raw, Mapping):
        return Checked([Issue("RULE_INVALID_SCHEMA", "a rule is an object" if raw is not None else "a rule or its text is required")])
    found: list[Issue] = []
    doc = _fitted(raw, SHAPE, "", found)
    if not found and not 1 <= doc["target_size"] <= rules.MOST_TRACKS:
        found.append(Issue("TARGET_SIZE_INVALID", f"from 1 to {rules.MOST_TRACKS} tracks", "target_size"))
    if found:
        return Checked(found)
    errors, warnings = _meaning(doc, known, future)
    return Checked(errors, warnings, None if errors else doc, None if errors else _rule(doc))


def _meaning(doc: dict[str, Any], known: Sequence[str], future: Sequence[str]) -> tuple[list[Issue], list[Issue]]:
    errors, warnings = [], []
    source, features, components = doc["source"], doc["filters"]["features"], doc["weights"]["components"]
    if not (source["liked_tracks"] or source["playlists_include"] or source["track_ids_include"]):
        errors.append(Issue("NO_SOURCE_SELECTED", "at least one source must be selected", "source"))
    if source["clusters_include"] or source["clusters_exclude"]:
        warnings.append(Issue("CLUSTER_SOURCE_NOT_AVAILABLE_YET", "clusters are no source yet", "source"))
    if source["seed_tracks"]:
        warnings.append(Issue("SEED_TRACKS_NOT_AVAILABLE_IN_PHASE_5", "seed tracks have no effect yet", "source.seed_tracks"))
    for name, spec in features.items():
        own, path = rules.ALIASES.get(name, name), f"filters.features.{name}"
        if own not in known and own not in future:
            errors.append(Issue("UNKNOWN_FILTER", f"no feature {name}", path))
            continue
        if own in future:
            warnings.append(Issue("FEATURE_NOT_AVAILABLE_YET", f"{name} is not computed yet", path))
        if spec["min"] is not None and spec["max"] is not None and spec["min"] > spec["max"]:
            errors.append(Issue("INVALID_RANGE", f"min > max for {name}", path))
    if sum(c["weight"] for c in components.values()) <= 0:
        errors.append(Issue("NO_SCORING_COMPONENTS", "the weights must add up to more than 0", "weights.components"))
    for name in components:
        own, path = rules.ALIASES.get(name, name), f"weights.components.{name}"
        if own in future:
            warnings.append(Issue("FEATURE_NOT_AVAILABLE_YET", f"{name} is not computed yet", path))
        elif own not in (*known, *rules.DERIVED, *rules.DERIVED_BY):
            errors.append(Issue("UNKNOWN_FILTER", f"no component {name}", path))
    mode = doc["ordering"]["mode"]
    if mode in rules.FUTURE_ORDERINGS:
        errors.append(Issue("ORDERING_MODE_NOT_AVAILABLE_YET", f"{mode} is not offered yet", "ordering.mode"))
    elif mode not in ORDERINGS:
        errors.append(Issue("RULE_INVALID_SCHEMA", f"one of {', '.join(ORDERINGS)} is expected", "ordering.mode"))
    if doc["spotify"]["sync_mode"] not in rules.SYNC_MODES:
        errors.append(Issue("UNKNOWN_SYNC_MODE", f"one of {', '.join(rules.SYNC_MODES)} is expected", "spotify.sync_mode"))
    if doc["constraints"]["cluster_diversity"]["enabled"]:
        warnings.append(Issue("CLUSTER_SOURCE_NOT_AVAILABLE_YET", "clusters are no constraint yet", "constraints.cluster_diversity"))
    if doc["constraints"]["vocal_balance"]["enabled"]:
        warnings.append(Issue("FEATURE_NOT_AVAILABLE_YET", "vocal balance has no effect yet", "constraints.vocal_balance"))
    return errors, warnings


def _rule(doc: dict[str, Any]) -> rules.Rule:
    source, filters, constraints = doc["source"], doc["filters"], doc["constraints"]
    listed = lambda status: (status or {}).get("include", [])
    own = lambda name: rules.ALIASES.get(name, name)
    return rules.Rule(
        liked=source["liked_tracks"], playlists=source["playlists_include"], track_ids=source["track_ids_include"], exclude_playlists=source["playlists_exclude"], exclude_track_ids=source["track_ids_exclude"],
        filters=[rules.FeatureFilter(own(n), f["min"], f["max"], f["required"]) for n, f in filters["features"].items()], availability=listed(filters["availability_status"]), market=listed(filters["market_status"]),
        exclude_artists=filters["exclude_artists"], exclude_albums=filters["exclude_albums"], weights={own(n): c["weight"] for n, c in doc["weights"]["components"].items()},
        max_per_artist=constraints["max_tracks_per_artist"], max_per_album=constraints["max_tracks_per_album"], target_size=doc["target_size"], spread_artists=constraints["avoid_same_artist_consecutive"],
        ordering=doc["ordering"]["mode"], seed=doc["ordering"]["random_seed"] or 42, sync_mode=doc["spotify"]["sync_mode"], seed_tracks=source["seed_tracks"],
        clusters=[*map(str, source["clusters_include"]), *map(str, source["clusters_exclude"])], cluster_diversity=constraints["cluster_diversity"]["enabled"], vocal_balance=constraints["vocal_balance"]["enabled"],
    )
