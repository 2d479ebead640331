"""YAML read and written by libyaml, with the results of PyYAML's own parser and writer.

libyaml takes a sixth of the time. Texts that the two may read differently (tabs, byte order marks, tags, marks right after a block's or a
key's sign), those that libyaml refuses and trees that the two write differently (a scalar alone, text outside ASCII) go to PyYAML's own. So
do texts that may nest deep: libyaml's stack isn't guarded, PyYAML's raises RecursionError.
"""

from __future__ import annotations

import re

_OWN = re.compile("[\t\ufeff]|(?:^|[^\\w'\"])!|^[ ?:-]{40}|[|>][-+0-9]*#|\\?(?:[]},\\s]|$)", re.MULTILINE)
#: Opening brackets in a text that libyaml reads.
_OPEN = 100


def _plain(yaml, text: str) -> bool:
    return hasattr(yaml, "CSafeLoader") and text.count("[") + text.count("{") <= _OPEN and not _OWN.search(text)


def documents(text: str) -> list:
    """The documents of a YAML stream, as yaml.safe_load_all() reads them; what isn't YAML raises YAMLError."""
    import yaml

    if _plain(yaml, text):
        try:
            return list(yaml.load_all(text, yaml.CSafeLoader))
        except (yaml.YAMLError, UnicodeError):
            pass
    return list(yaml.safe_load_all(text))


def document(text: str):
    """The only document of a YAML text, None if there is none, as yaml.safe_load() reads it."""
    import yaml

    if _plain(yaml, text):
        try:
            return yaml.load(text, yaml.CSafeLoader)
        except (yaml.YAMLError, UnicodeError):
            pass
    return yaml.safe_load(text)


def written(node) -> str:
    """A tree as YAML in block style, as yaml.dump() writes it."""
    import yaml

    if hasattr(yaml, "CDumper") and isinstance(node, (dict, list)):
        out = yaml.dump(node, Dumper=yaml.CDumper, default_flow_style=False, allow_unicode=True)
        if out.isascii() and "\\" not in out:
            return out
    return yaml.dump(node, default_flow_style=False, allow_unicode=True)
