"""Command line: `analyze` (the default) prints a project's report, `callers` a symbol's caller tree."""

from __future__ import annotations

import logging
import os
import sys
from dataclasses import dataclass, field

from riskweave.model import FileFilterSettings, Settings
from riskweave.plans import views
from riskweave.plans.engine import RiskEngine

VERSION = "0.1.0"
HELP = """Usage: riskweave [analyze | callers] [options]

analyze:
  --root PATH                  project folder (default: the current one)
  --output FILE                write the report to a file
  --format json
  --[no-]exclude-tests         leave test files out (default: yes)
  --[no-]respect-gitignore     leave ignored files out (default: no)
  --[no-]call-graph            rank symbols by the call graph (default: yes)
  --verbose --help --version

callers:
  --file PATH --symbol NAME    the symbol (both are needed)
  --depth N                    levels of callers (default: 5)
  --format json|text
  --root, --[no-]exclude-tests, --[no-]respect-gitignore, --verbose as above
"""
_VALUES = ("root", "output", "format", "file", "symbol", "depth")
_SWITCHES = {"exclude-tests": True, "respect-gitignore": False, "call-graph": True}


@dataclass
class Options:
    command: str = "analyze"
    values: dict[str, str] = field(default_factory=dict)
    switches: dict[str, bool] = field(default_factory=lambda: dict(_SWITCHES))
    flags: set[str] = field(default_factory=set)

    @property
    def depth(self) -> int:
        """The leading number of --depth if it is positive, else 5."""
        import re

        m = re.match(r"\s*\+?(\d+)", self.values.get("depth", ""))
        return int(m[1]) if m and int(m[1]) > 0 else 5


def parse(arguments: list[str]) -> Options:
    """Unknown options are ignored; of a switch and its negation the last counts; a value option without a value is not set."""
    out, rest = Options(), list(arguments)
    if rest and rest[0] in ("callers", "analyze"):
        out.command = rest.pop(0)
    while rest:
        word = rest.pop(0)
        if not word.startswith("--"):
            continue
        name, given, value = word[2:].partition("=")
        if name in _VALUES:
            if not given and rest and not rest[0].startswith("-"):
                value, given = rest.pop(0), "="
            if given:
                out.values[name] = value
        elif name in _SWITCHES:
            out.switches[name] = True
        elif name.startswith("no-") and name[3:] in _SWITCHES:
            out.switches[name[3:]] = False
        else:
            out.flags.add(name)
    return out


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("riskweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(arguments: list[str] | None = None, spark=None, out=sys.stdout, err=sys.stderr) -> int:
    """The exit code: 0, or 1 with a message."""
    o = parse(sys.argv[1:] if arguments is None else arguments)
    if "help" in o.flags:
        out.write(HELP)
        return 0
    if "version" in o.flags:
        out.write(f"{VERSION}\n")
        return 0
    kind = o.values.get("format", "json")
    allowed = ("json", "text") if o.command == "callers" else ("json",)
    missing = [n for n in ("file", "symbol") if not o.values.get(n)] if o.command == "callers" else []
    if missing:
        err.write(f"Error: --{missing[0]} is required for the callers command\n")
        return 1
    if kind not in allowed:
        err.write(f"Error: unsupported format '{kind}'. Supported formats: {', '.join(allowed)}\n")
        return 1
    logging.basicConfig(level=logging.DEBUG if "verbose" in o.flags else logging.WARNING, stream=err)
    root = os.path.abspath(o.values.get("root", os.getcwd()))
    settings = Settings(exclude_tests=o.switches["exclude-tests"], file_filter=FileFilterSettings(o.switches["respect-gitignore"]))
    try:
        analysis = RiskEngine(spark or _session(), settings).analyze_folder(root, o.switches["call-graph"] or o.command == "callers")
        if o.command == "callers":
            result = views.callers_result(analysis, o.values["file"], o.values["symbol"], o.depth)
            text = views.callers_text(result) if kind == "text" else views.callers_json(result)
        else:
            text = views.json_report(analysis, root)
        if o.command == "analyze" and o.values.get("output"):
            with open(o.values["output"], "w", encoding="utf-8") as f:
                f.write(text)
        else:
            out.write(text)
    except Exception as e:  # noqa: BLE001  the command line reports every failure
        err.write(f"Error: {e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
