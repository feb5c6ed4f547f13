"""Command line: run a program, print its pages' text, or make a document.

    python -m pagemill run FILE        what the program prints
    python -m pagemill ir FILE         the text of its pages
    python -m pagemill pdf FILE OUT    its pages as a document

Exit codes: 0 the program ended well, 1 it failed, 2 the call is wrong, 3 the budget ran out.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .operators.programs import Config, interpreter

CODES = {"ok": 0, "error": 1, "budget": 3}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pagemill")
    parser.add_argument("action", choices=("run", "ir", "pdf"))
    parser.add_argument("file")
    parser.add_argument("out", nargs="?")
    parser.add_argument("--budget", type=int, help="objects that may be executed")
    parser.add_argument("--prelude", help="a program that is run first")
    parser.add_argument("--param", action="append", default=[], metavar="KEY=VALUE", help="a distiller parameter, VALUE as the language writes it")
    parser.add_argument("--lock", action="append", default=[], metavar="KEY", help="a distiller parameter that the program can't change")
    parser.add_argument("--identity", action="append", default=[], metavar="KEY=VALUE", help="an entry of statusdict")
    parser.add_argument("--embed-all", action="store_true", help="EmbedAllFonts true")
    parser.add_argument("--no-subset", action="store_true", help="SubsetFonts false")
    parser.add_argument("--no-compress", action="store_true")
    parser.add_argument("--no-graphics", action="store_true")
    try:
        o = parser.parse_args(arguments)
        if o.action == "pdf" and not o.out:
            parser.error("pdf needs a file to write")
        program = Path(o.file).read_bytes()
        prelude = Path(o.prelude).read_bytes() if o.prelude else b""
        given = dict(p.split("=", 1) for p in o.param)
        given |= ({"EmbedAllFonts": "true"} if o.embed_all else {}) | ({"SubsetFonts": "false"} if o.no_subset else {})
        identity = dict(p.split("=", 1) for p in o.identity)
    except SystemExit as e:
        return 0 if not e.code else 2
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    from .vm import dump, pdf

    # what the call states is said in the language before the program runs
    asked = " ".join(f"/{k} {v}" for k, v in given.items())
    said = "".join(f"statusdict /{k} {v} put\n" for k, v in identity.items()) + (f"<< {asked} >> setdistillerparams\n" if given else "")
    vm = interpreter(Config(budget=o.budget, prelude=said.encode("latin-1", "replace") + prelude, graphics=not o.no_graphics, clock=None))
    outcome, _, _ = vm.job(program)
    sys.stdout.buffer.write(bytes(vm.out))
    sys.stderr.buffer.write(bytes(vm.err))
    pages = vm.graphics.pages if vm.graphics else []
    if o.action == "ir":
        sys.stdout.write("\n".join(map(dump.page_text, pages)))
    if o.action == "pdf":
        events = [e for e in vm.events if e[0] != "param" or e[1] not in o.lock] + [("param", k, given[k]) for k in o.lock if k in given]
        Path(o.out).write_bytes(pdf.write(pages, events, not o.no_compress))
    return CODES[outcome]


if __name__ == "__main__":
    sys.exit(main())
