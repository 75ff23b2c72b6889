"""The command line: convert files, and work with template packs.

    python -m quire.cli [options] FILE...
    python -m quire.cli templates VERB ...
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Sequence
from dataclasses import replace

from quire import library
from quire.functions.decode import decode_bytes
from quire.operators import catalog, convert, machine, sections
from quire.operators.records import split_chars
from quire.options import ConvertOptions, OptionError, check, from_arguments, kind, last_preset, layered, option_file, settled
from quire.sources import files, packs


#: Before a dictionary's path: its rules go after the built-in ones.
LAST = "last:"


def usage() -> str:
    return "usage: quire [options] FILE...\n" + "\n".join(f"  --{n} ({kind(n)})" for n in ConvertOptions.__dataclass_fields__)


def options_of(arguments: Sequence[str]) -> ConvertOptions:
    """@file arguments first, then a preset, then the rest."""
    texts, rest = [], []
    for a in arguments:
        if a.startswith("@"):
            with open(a[1:], encoding="utf-8") as f:
                texts.append(f.read())
        else:
            rest.append(a)
    words = [w for t in texts for w in option_file(t)]
    name = last_preset([*words, *rest])
    return layered(texts, library.PRESETS.get(name) if name else None, rest)


def template_of(options: ConvertOptions) -> tuple[ConvertOptions, str]:
    if options.template_library:
        whole, html = library.template(options.template_library)
        return replace(options, document_template=options.template_library if whole else "", body_template="" if whole else options.template_library, template_library=""), html
    path = options.document_template or options.body_template
    return options, files.side_text(path) if path else ""


def read(options: ConvertOptions) -> tuple[list[str], list[str]]:
    """(texts, inputs that can't be read)."""
    texts, missing = list(options.instring), []
    for path in options.infile or (() if texts else ("-",)):
        try:
            raw = sys.stdin.buffer.read() if path == "-" else open(path, "rb").read()
        except OSError:
            missing.append(path)
            continue
        texts.append(decode_bytes(raw, options.encoding)[0])
    return texts, missing


def write(options: ConvertOptions, name: str, html: str) -> None:
    if name in ("", "-"):
        try:
            sys.stdout.write(html)
        except BrokenPipeError:
            return
    elif any(files.same_target(name, p) for p in options.infile):
        raise OptionError(f"{name} is an input")
    else:
        files.save_html(html, name)


def run(arguments: Sequence[str]) -> int:
    options, template = template_of(settled(options_of(arguments)))
    check(replace(options, template_library=""))
    texts, missing = read(options)
    for path in missing:
        print(f"Could not open {path}", file=sys.stderr)
    first, last = ([files.side_text(d.removeprefix(LAST)) for d in options.links_dictionaries if d.startswith(LAST) is late] for late in (False, True))
    rules = convert.load_rules(options, first, last)
    text = "\n\n".join(texts)
    folder, stem = os.path.split(os.path.splitext(options.outfile)[0])
    if options.chunk_chars:
        made = [(f"{stem}-chunk-{i:02d}.html", convert.document(c, replace(options, chunk_chars=0), rules)["html"]) for i, c in enumerate(split_chars(text, options.chunk_chars), 1)]
    elif options.chunk:
        got = machine.to_html(text, options, rules)
        made = sections.paged(got["start"], got["body"], got["tail"], stem or "output", options.section, options.toc)
    else:
        got = convert.document(text, options, rules, template, bool(options.instring), convert.side_texts(options))
        if got["error"]:
            print(got["error"], file=sys.stderr)
            return 1
        made = [(options.outfile, got["html"])]
        folder = ""
    for name, html in made:
        write(options, os.path.join(folder, name) if folder else name, html)
    if options.report:
        html = "".join(h for _, h in made)
        print(", ".join(f"{n} {w}" for w, n in (("bytes", len(html.encode())), ("headings", sum(html.count(f"<h{i}") for i in range(1, 7))), ("paragraphs", html.count("<p>") + html.count("<p ")), ("breaks", html.count("<br")))), file=sys.stderr)
    return 1 if missing else 0


def templates(arguments: Sequence[str]) -> int:
    """list, inspect, new, install, remove, pack, unpack, validate, search, verify, sources, update."""
    roots = [a.partition("=")[2] for a in arguments if a.startswith("--template_dir=")] or [os.path.expanduser("~/.config/quire/templates")]
    folders = [a.partition("=")[2] for a in arguments if a.startswith("--catalog_dir=")]
    words = [a for a in arguments if not a.startswith("--")]
    verb, rest = (words[0], words[1:]) if words else ("list", [])
    installed = {}
    for root in roots:
        for name in sorted(os.listdir(root)) if os.path.isdir(root) else []:
            if os.path.isfile(os.path.join(root, name, "template.toml")):
                installed.setdefault(name, os.path.join(root, name))
    entries = [e for f in folders if os.path.isfile(os.path.join(f, "catalog.toml")) for e in packs.index(files.side_text(os.path.join(f, "catalog.toml")), f)[0]]
    if verb == "list":
        rows = [{"address": n, "model": m} for n, (m, _) in library.TEMPLATES.items()] + [{"address": n, "model": "pack"} for n in installed]
        print(json.dumps(rows) if "--json" in arguments else "\n".join(r["address"] for r in rows))
    elif verb == "inspect":
        print(library.TEMPLATES[rest[0]][1] if rest[0] in library.TEMPLATES else files.side_text(os.path.join(installed[rest[0]], "template.toml")))
    elif verb == "new":
        os.makedirs(rest[0])
        for name, text in catalog.scaffold(os.path.basename(rest[0])).items():
            write(ConvertOptions(), os.path.join(rest[0], name), text)
    elif verb == "install":
        entry = next((e for e in entries if rest[0] in (e["id"], f"{e['id']}@{e['version']}")), None)
        known = [f"{e['id']}@{e['version']} in {e['catalog']}" for e in entries if e["id"] == rest[0].partition("@")[0]]
        if not entry and known and not os.path.exists(rest[0]):
            raise OptionError(f"no {rest[0]}; there are {', '.join(known)}")
        if entry:
            with open(os.path.join(entry["catalog"], entry["archive"]), "rb") as f:
                print(packs.install_archive(f.read(), roots[0], entry["sha256"]))
        elif os.path.isdir(rest[0]):
            print(packs.install(packs.folder_files(rest[0]), roots[0]))
        else:
            with open(rest[0], "rb") as f:
                print(packs.install_archive(f.read(), roots[0]))
    elif verb == "remove":
        packs.remove(roots[0], rest[0])
    elif verb == "pack":
        with open(rest[1], "wb") as f:
            f.write(catalog.pack(packs.folder_files(rest[0])))
    elif verb == "unpack":
        for name, _, _, content in catalog.unpack(open(rest[0], "rb").read()):
            full = os.path.join(rest[1], name)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "wb") as f:
                f.write(content)
    elif verb == "validate":
        wrong = packs.check(packs.folder_files(rest[0]))
        print("\n".join(wrong) or "ok")
        return 1 if wrong else 0
    elif verb == "search":
        q = rest[0].lower()
        print("\n".join(f"{e['id']}@{e['version']}" for e in entries if any(q in (x or "").lower() for x in (e["id"], e["name"], e["description"], *e["tags"]))))
    elif verb == "verify":
        import hashlib

        bad = [n for n, path in installed.items() for e in entries if e["id"] == n and e["sha256"] != hashlib.sha256(catalog.pack(packs.folder_files(path))).hexdigest()]
        print("\n".join(f"{n}: differs" for n in bad) or "ok")
        return 1 if bad else 0
    elif verb == "sources":
        print("\n".join([*roots, *folders]))
    elif verb == "update":
        print("\n".join(f"{f}: {sum(e['catalog'] == f for e in entries)} packs" for f in folders))
    else:
        raise OptionError(f"unknown verb {verb!r}")
    return 0


def main(arguments: Sequence[str]) -> int:
    if "--help" in arguments or "-h" in arguments:
        print(usage())
        return 0
    try:
        return templates(arguments[1:]) if arguments[:1] == ["templates"] else run(arguments)
    except (OptionError, ValueError, OSError) as why:
        print(f"quire: {why}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
