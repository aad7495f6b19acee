"""Crawl options, their validation, and the command line."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, fields

from tidepool.functions import addresses
from tidepool.functions.urls import PolicyError, canonicalize


class ConfigError(ValueError):
    def __init__(self, name: str, message: str) -> None:
        super().__init__(f"{name}: {message}")
        self.field = name


@dataclass
class Config:
    output: str = "./crawl-out"
    max_depth: int = 3
    max_pages: int = 1000
    concurrency: int = 8
    per_host_concurrency: int = 2
    delay_ms: int = 250
    timeout_ms: int = 30_000
    retries: int = 2
    max_body_size: int = 10 << 20
    max_total_bytes: int = 500 << 20
    query_mode: str = "drop"
    redirect_policy: str = "same-origin"
    sitemap: str = "auto"
    ignore_robots: bool = False
    include_subdomains: bool = False
    allow_private_network: bool = False
    fresh: bool = False
    merge: bool = False
    for_queries: list[str] = field(default_factory=list)
    for_prune: bool = False
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    report: str = "text"
    progress: str = "auto"
    #: ordered (rules as a fold over the file) or rfc9309 (longest match).
    robots_mode: str = "ordered"
    #: level (whole levels) or exact (batches of `concurrency`, as a budget in pages needs).
    batch_mode: str = "level"

    def validate(self) -> None:
        if not self.output:
            raise ConfigError("output", "path must not be empty")
        for name in ("max_pages", "concurrency", "per_host_concurrency"):
            if getattr(self, name) <= 0:
                raise ConfigError(name.replace("_", "-"), "must be greater than zero")
        if self.per_host_concurrency > self.concurrency:
            raise ConfigError("per-host-concurrency", "must not exceed concurrency")
        for name, key in (("timeout_ms", "timeout"), ("max_body_size", "max-body-size"), ("max_total_bytes", "max-total-bytes")):
            if getattr(self, name) <= 0:
                raise ConfigError(key, "must be greater than zero")
        if self.max_body_size > self.max_total_bytes:
            raise ConfigError("max-body-size", "must not exceed max-total-bytes")
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ConfigError(name.replace("_", "-"), f"must be one of {', '.join(allowed)}")

    def fingerprint(self, start_url: str) -> str:
        """Identifies runs that may continue each other: all that decides what is crawled but globs, queries and merging."""
        out = {k: v for k, v in asdict(self).items() if k not in ("include", "exclude", "for_queries", "for_prune", "merge", "report", "batch_mode", "robots_mode")}
        return hashlib.sha256(json.dumps(out | {"start": start_url}, sort_keys=True).encode()).hexdigest()

    @property
    def lease_ms(self) -> int:
        return 4 * self.timeout_ms + 60_000


CHOICES = {
    "query_mode": ("drop", "preserve"), "redirect_policy": ("same-origin",), "sitemap": ("auto", "on", "off"), "report": ("text", "json"),
    "progress": ("auto", "text", "json", "none"), "robots_mode": ("ordered", "rfc9309"), "batch_mode": ("level", "exact"),
}
_FLAGS = {"ignore-robots", "include-subdomains", "allow-private-network", "fresh", "merge", "for-prune"}
_LISTS = {"include": "include", "exclude": "exclude", "for": "for_queries"}
_DURATIONS, _SIZES = {"delay": "delay_ms", "timeout": "timeout_ms"}, {"max-body-size", "max-total-bytes"}


def parse_duration(text: str) -> int:
    """Milliseconds of 250ms, 30s or 2m."""
    m = re.fullmatch(r"(\d+)(ms|s|m)", text)
    if not m:
        raise ConfigError("duration", f"invalid duration {text!r}")
    return int(m[1]) * {"ms": 1, "s": 1000, "m": 60_000}[m[2]]


def parse_bytes(text: str) -> int:
    """Bytes of 512, 512B, 10KiB, 5MiB or 1GiB."""
    m = re.fullmatch(r"(\d+)(B|KiB|MiB|GiB)?", text)
    if not m:
        raise ConfigError("size", f"invalid byte size {text!r}")
    return int(m[1]) << {None: 0, "B": 0, "KiB": 10, "MiB": 20, "GiB": 30}[m[2]]


def validate_start_url(url: str, allow_private: bool = False) -> None:
    if not re.match(r"https?://[^/?#]", url, re.I):
        raise ConfigError("start-url", "must be an absolute http or https URL")
    try:
        host = canonicalize(url, allow_private=True).host
    except PolicyError as e:
        raise ConfigError("start-url", str(e)) from e
    if not allow_private and private_host(host):
        raise ConfigError("start-url", f"{host} is a private address; allow-private-network permits it")


def private_host(host: str) -> bool:
    """The names and addresses that a start URL may not have by default; the policy for pages is stricter."""
    if host == "localhost":
        return True
    try:
        ip = addresses.ipaddress.ip_address(host)
    except ValueError:
        return False
    nets = ["127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"] if ip.version == 4 else ["::1/128"]
    return any(ip in addresses.ipaddress.ip_network(n) for n in nets)


@dataclass
class Command:
    """kind: crawl (urls, config), search (directory, query, json, mode), help or version."""

    kind: str
    urls: list[str] = field(default_factory=list)
    config: Config | None = None
    directory: str = ""
    query: str = ""
    json: bool = False
    mode: str = "combined"


def help_text() -> str:
    options = "\n".join(f"  --{f.name.replace('_ms', '').replace('_', '-').replace('for-queries', 'for')}" for f in fields(Config))
    return f"usage: tidepool [crawl] URL... [options]\n       tidepool search DIRECTORY QUERY... [--json] [--mode combined|separate|all]\n\noptions:\n{options}\n"


def parse_args(args: list[str]) -> Command:
    config, urls, rest, only_urls = Config(), [], list(args), False
    while rest:
        arg = rest.pop(0)
        if only_urls or not arg.startswith("-"):
            if not only_urls and arg == "search" and not urls:
                return _parse_search(rest)
            if only_urls or arg != "crawl" or urls:
                urls.append(arg)
            continue
        if arg == "--":
            only_urls = True
            continue
        if arg in ("-h", "--help"):
            return Command("help")
        if arg in ("-V", "--version"):
            return Command("version")
        name, given, value = arg.partition("=")
        name = "output" if name == "-o" else name.removeprefix("--")
        if name in _FLAGS:
            if given:
                raise ConfigError(name, "takes no value")
            setattr(config, name.replace("-", "_"), True)
            continue
        known = {f.name.replace("_", "-") for f in fields(Config)} | _LISTS.keys() | _DURATIONS.keys()
        if name not in known:
            raise ConfigError(name, "unknown option")
        if not given:
            if not rest:
                raise ConfigError(name, "requires a value")
            value = rest.pop(0)
        if name in _LISTS:
            getattr(config, _LISTS[name]).append(value)
        elif name in _DURATIONS:
            setattr(config, _DURATIONS[name], parse_duration(value))
        elif name in _SIZES:
            setattr(config, name.replace("-", "_"), parse_bytes(value))
        elif isinstance(getattr(config, name.replace("-", "_")), int):
            if not re.fullmatch(r"\d+", value):
                raise ConfigError(name, f"invalid value {value!r}")
            setattr(config, name.replace("-", "_"), int(value))
        else:
            setattr(config, name.replace("-", "_"), value)
    if not urls:
        raise ConfigError("start-url", "missing")
    for url in urls:
        validate_start_url(url, config.allow_private_network)
    config.validate()
    return Command("crawl", urls, config)


def _parse_search(rest: list[str]) -> Command:
    if not rest:
        raise ConfigError("search", "requires a corpus directory")
    out, words = Command("search", directory=rest.pop(0)), []
    while rest:
        arg = rest.pop(0)
        if arg == "--json":
            out.json = True
        elif arg.startswith("--mode"):
            _, given, value = arg.partition("=")
            if not given and not rest:
                raise ConfigError("mode", "requires a value")
            out.mode = value if given else rest.pop(0)
        else:
            words.append(arg)
    out.query = " ".join(words)
    if not out.query:
        raise ConfigError("search", "requires a query")
    if out.mode not in ("combined", "separate", "all"):
        raise ConfigError("mode", "must be combined, separate or all")
    return out
