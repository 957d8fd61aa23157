"""A plain line-by-line machine for the markup, to hold the window passes against."""

import re

SP = r"[\t\n\f\r    -     　]"
ZS = "\t                　"
HEAD = re.compile(rf"(INT|EXT|EST|(I|INT)\.?/(E|EXT)\.?)([.\-]|{SP})[^\n]+\Z", re.I | re.A)
NUMBER = re.compile(rf"#([^\n#]*?)#{SP}*\Z")


def body(text):
    text = re.sub(rf"\A{SP}*", "", text)
    text = re.sub(r"\r\n|\r", "\n", text) + "\n\n"
    top = text.split("\n\n")[0]
    lines = top.split("\n")
    is_open = lambda s: re.match(rf"(?!{SP})[^\n][^:]+:{SP}*\Z", s)
    is_inline = lambda s: re.match(rf"(?!{SP})[^\n][^:]+:{SP}*(?!{SP})[^\n]", s)
    keys = [s for s in lines if is_open(s) or is_inline(s)]
    if keys and not (len(keys) == 1 and is_open(lines[-1])):
        text = text.replace(top, "")
    return "\n" + text


def parse(text):
    """[type, text, centered, scene number, dual, depth] of every element."""
    out = []
    gap = comment = spoken = False
    notes = ""
    lines = re.split("[\n\x0b\f\r\x85  ]", body(text))

    def add(kind, s, **more):
        out.append({"kind": kind, "text": s, "centered": False, "number": None, "dual": False, "depth": 0, **more})

    def speech(s):
        if out[-1]["kind"] == "Dialogue":
            out[-1]["text"] += "\n" + s
        else:
            add("Dialogue", s)

    for i, s in enumerate(lines):
        first, bare = s[:1], s.strip(ZS)
        closes = re.search(rf"\*/{SP}*\Z", s)
        if first == "~":
            if out and out[-1]["kind"] == "Lyrics" and gap:
                add("Lyrics", " ")
            add("Lyrics", s)
        elif first == "!":
            add("Action", s)
        elif first == "@":
            add("Character", s)
            spoken = True
        elif re.fullmatch(rf"{SP}{{2,}}", s):
            speech(s) if len(s) == 2 and spoken else add("Action", s)
        elif s == "" and not comment:
            spoken, gap = False, True
            continue
        elif s.startswith("/*"):
            if not closes:
                comment, notes = True, notes + "\n"
                continue
            comment = False
            add("Boneyard", s.replace("/*", "").replace("*/", ""))
        elif closes:
            add("Boneyard", notes)
            comment, notes = False, ""
        elif comment:
            notes += s + "\n"
            continue
        elif re.fullmatch(rf"={{3,}}{SP}*", s):
            add("Page Break", s)
        elif bare[:1] == "=":
            add("Synopsis", re.sub(rf"\A{SP}*=", "", s))
            continue
        elif gap and re.fullmatch(rf"{SP}*\[\[{SP}*[^\]\n]+{SP}*\]\]{SP}*", s):
            add("Comment", s.replace("[[", "").replace("]]", "").strip(ZS))
            continue
        elif bare[:1] == "#":
            mark = re.match(rf"{SP}*#+", s)[0]
            if s != mark:
                add("Section Heading", s[len(mark) :], depth=len(mark))
        elif len(s) > 1 and first == "." and s[1] != ".":
            n = NUMBER.search(s)
            add("Scene Heading", NUMBER.sub("", s)[1:].strip(ZS), number=n and n[1])
        elif gap and HEAD.match(s):
            n = NUMBER.search(s)
            add("Scene Heading", NUMBER.sub("", s), number=n and n[1])
        elif s.endswith("TO:") or re.sub(rf"\A{SP}*", "", s) in ("FADE OUT.", "CUT TO BLACK.", "FADE TO BLACK."):
            add("Transition", s)
        elif first == ">" and len(s) > 1 and s[-1] == "<":
            add("Action", s[1:].strip(ZS)[:-1].strip(ZS), centered=True)
        elif first == ">":
            add("Transition", s[1:].strip(ZS))
        elif gap and re.fullmatch(r"[^a-z]+(\(cont'd\))?", s) and i + 1 < len(lines) and lines[i + 1] != "":
            caret = re.search(rf"{SP}*\^{SP}*\Z", s)
            if caret:
                for e in reversed(out):
                    if e["kind"] == "Character":
                        e["dual"] = True
                        break
            add("Character", s[: caret.start()] if caret else s, dual=bool(caret))
            spoken = True
        elif spoken:
            if not gap and re.match(rf"{SP}*\(", s):
                add("Parenthetical", s)
            else:
                speech(s)
            continue
        elif not gap and out:
            if out[-1]["kind"] == "Scene Heading":
                out[-1]["kind"] = "Action"
            out[-1]["text"] += "\n" + s
        else:
            add("Action", s)
        gap = False
    return out
