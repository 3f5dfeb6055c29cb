"""A small shipping service in five languages, with the rows an extraction must give.

Programs and expectations were made for these tests; the expectations were read off the
texts by hand.
"""

DOCKER = """FROM debian:stable
ENV QUEUE_DSN amqp://broker
ARG GIT_REF
ARG CACHE_PORT="6380"
  ENV THEME='dark'
RUN make ${GIT_REF}
arg NOTHING=1
ARG small_name=1
ENV QUEUE_DSN=second
ARG EMPTY_ONE=
"""

SHELL = """#!/usr/bin/env bash
set -eu
workdir=/srv
STAMP=$(date)
cd "$workdir" && log "$STAMP"
exec ledger --queue "${QUEUE_DSN}" --ref "${GIT_REF:-head}" $AUDIT_TOKEN
# rotate ${AUDIT_TOKEN}
export RETRIES=3
echo "$RETRIES $# $?"
"""

TYPESCRIPT = """import { open } from "./door";
const ref = process.env.GIT_REF ?? "none";
const quiet = ["1", "on"].includes(process.env["DESK_QUIET"]);
// process.env.OLD_NAME
open(`wss://${process.env.DESK_HOST}:${process.env.CACHE_PORT}/process.env.NOT_CODE`);
const { env } = process;
export const at = process.env[pick()];
"""

PYTHON = '''from os import path
import os


class Ledger:
    dsn = os.environ["QUEUE_DSN"]
    page = int(os.environ.get("PAGE_SIZE", '40'))
    note = "os.getenv('IN_TEXT')"

    def url(self, tail=os.getenv("MIRROR_URL", "https://mirror.example")):
        return f"{os.getenv('REGION')}/{tail}"  # os.getenv("IN_COMMENT")


KEYS = [os.getenv(k) for k in ("A", "B")]
AUDIT = os.getenv(
    "AUDIT_TOKEN",
)
'''

GO = """package relay

import "os"

// os.Getenv("GONE")
var region, hasRegion = os.LookupEnv("REGION")

func token() (string, bool) {
\tif v := os.Getenv("AUDIT_TOKEN"); v != "" {
\t\treturn v, true
\t}
\treturn os.Getenv("RELAY_" + "KEY"), os.Getenv("RELAY_ENABLED") == `os.Getenv("RAW")`
}
"""

FILES = {
    "Dockerfile": DOCKER,
    "boot.bash": SHELL,
    "desk.ts": TYPESCRIPT,
    "ledger.py": PYTHON,
    "relay.go": GO,
}

# (name, type, required, default, language, locations)
INVENTORY = [
    ("QUEUE_DSN", "URL", True, "amqp://broker", "docker", "Dockerfile:2 boot.bash:6 ledger.py:6"),
    ("GIT_REF", "STRING", True, None, "docker", "Dockerfile:3 boot.bash:6 desk.ts:2"),
    ("CACHE_PORT", "PORT", True, "6380", "docker", "Dockerfile:4 desk.ts:5"),
    ("THEME", "STRING", False, "dark", "docker", "Dockerfile:5"),
    ("EMPTY_ONE", "STRING", False, "", "docker", "Dockerfile:10"),
    ("AUDIT_TOKEN", "SECRET", True, None, "shell", "boot.bash:6 boot.bash:7 ledger.py:15 relay.go:9"),
    ("RETRIES", "INTEGER", True, None, "shell", "boot.bash:9"),
    ("DESK_QUIET", "STRING", True, None, "javascript", "desk.ts:3"),
    ("DESK_HOST", "STRING", True, None, "javascript", "desk.ts:5"),
    ("PAGE_SIZE", "INTEGER", False, "40", "python", "ledger.py:7"),
    ("MIRROR_URL", "URL", False, "https://mirror.example", "python", "ledger.py:10"),
    ("REGION", "STRING", True, None, "python", "ledger.py:11 relay.go:6"),
    ("RELAY_ENABLED", "BOOLEAN", True, None, "go", "relay.go:12"),
]
N_LOCATIONS = 22

# (file, name): byte column
COLUMNS = {
    ("Dockerfile", "THEME"): 0, ("boot.bash", "RETRIES"): 0,
    ("desk.ts", "GIT_REF"): 12, ("desk.ts", "DESK_QUIET"): 35,
    ("desk.ts", "DESK_HOST"): 14, ("desk.ts", "CACHE_PORT"): 39,
    ("ledger.py", "QUEUE_DSN"): 10, ("ledger.py", "PAGE_SIZE"): 15, ("ledger.py", "MIRROR_URL"): 23,
    ("ledger.py", "REGION"): 18, ("ledger.py", "AUDIT_TOKEN"): 8,
    ("relay.go", "REGION"): 24, ("relay.go", "AUDIT_TOKEN"): 9, ("relay.go", "RELAY_ENABLED"): 37,
}

SIMPLE_TEMPLATE = """THEME=light
GIT_REF=main
PAGE_SIZE=25
LEGACY_FLAG=0
"""
COMMENTED_TEMPLATE = """# how the desk looks
THEME=light
# which build
# a branch or a tag
GIT_REF=main

# rows on a page
PAGE_SIZE=25
"""
SECTIONED_TEMPLATE = """# == relay ==
RELAY_ENABLED=1

# == broker ==
QUEUE_DSN=amqp://localhost
RETRIES=5
REGION=north

# == desk ==
DESK_HOST=localhost
"""
