"""References inside JSON documents."""

from __future__ import annotations

from collections.abc import Mapping


def follow(root: Mapping[str, object], pointer: str) -> object:
    """What a pointer such as ``#/definitions/Node`` refers to in a document; an unknown one raises an error."""
    if pointer != "#" and not pointer.startswith("#/"):
        raise ValueError(f"{pointer} is not inside the document")
    found: object = root
    for part in pointer.split("/")[1:]:
        name = part.replace("~1", "/").replace("~0", "~")
        if isinstance(found, Mapping) and name in found:
            found = found[name]
        elif isinstance(found, (list, tuple)) and name.isdigit() and int(name) < len(found):
            found = found[int(name)]
        else:
            raise ValueError(f"{pointer} leads nowhere")
    return found
