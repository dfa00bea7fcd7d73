"""The manager's configuration file: knowledge bases with their files, and preferences."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field


@dataclass
class Config:
    preferences: dict[str, str] = field(default_factory=dict)
    kbs: dict[str, list[str]] = field(default_factory=dict)
    #: Elements that aren't understood, kept as they were.
    other: list[str] = field(default_factory=list)


def read(text: str) -> Config:
    c = Config()
    for e in ET.fromstring(text):
        if e.tag == "preference" and e.get("name"):
            c.preferences[e.get("name")] = e.get("value", "")
        elif e.tag == "kb" and e.get("name"):
            c.kbs[e.get("name")] = [x.get("filename") for x in e.iter("constituent") if x.get("filename")]
        else:
            c.other.append(ET.tostring(e, encoding="unicode").strip())
    return c


def write(c: Config) -> str:
    root = ET.Element("configuration")
    for k, v in c.preferences.items():
        ET.SubElement(root, "preference", name=k, value=v)
    for k, files in c.kbs.items():
        kb = ET.SubElement(root, "kb", name=k)
        for f in files:
            ET.SubElement(kb, "constituent", filename=f)
    for x in c.other:
        root.append(ET.fromstring(x))
    ET.indent(root)
    return ET.tostring(root, encoding="unicode") + "\n"
