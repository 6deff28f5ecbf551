"""Species labels, keywords and sidecar text on Columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import constants as C

# Regions whose label names an animal.
ANIMAL_REGIONS = [
    C.ANIMAL_EYES, C.ANIMAL_HEAD, C.ANIMAL_BODY, C.DETECTOR_EYES, C.DETECTOR_HEAD, C.DETECTOR_BODY,
]


def normalise_label(label: Column) -> Column:
    return F.initcap(label)


def is_animal(label: Column) -> Column:
    return F.lower(label).isin(*C.ANIMALS)


def is_bird(label: Column) -> Column:
    return F.lower(label).isin(*bird_subset())


def bird_subset() -> list[str]:
    """Animal labels that are also birds."""
    birds = set(C.BIRDS)
    return [a for a in C.ANIMALS if a in birds]


def class_label(index: Column) -> Column:
    """Name of a class index; the list has a fixed length, so it is a literal and not a join."""
    names = F.array(*[F.lit(n) for n in C.CLASS_LABELS])
    return F.coalesce(F.get(names, index), F.lit("unknown"))


def species_group(region: Column, label: Column, bird_terms: Sequence[str] = C.BIRD_TERMS) -> Column:
    bird = F.lower(label).rlike("|".join(bird_terms))
    return (
        F.when(~F.coalesce(region.isin(*ANIMAL_REGIONS), F.lit(False)), "Wildlife")
        .when(F.coalesce(bird, F.lit(False)), "Birds")
        .otherwise("Mammals")
    )


def hierarchical_keyword(group: Column, label: Column) -> Column:
    return F.concat(F.lit("Wildlife|"), group, F.lit("|"), label)


def xml_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


# The sidecar document. Readers depend on the element names and namespaces; the
# toolkit attribute is free text and is filled in by the caller.
XMP_TEMPLATE = """\
<?xml version="1.0" encoding="UTF-8"?>
<x:xmpmeta xmlns:x="adobe:ns:meta/" x:xmptk="{toolkit}">
  <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
    <rdf:Description rdf:about=""
        xmlns:dc="http://purl.org/dc/elements/1.1/"
        xmlns:lr="http://ns.adobe.com/lightroom/1.0/">

      <!-- Flat keyword — appears in Lightroom keyword list -->
      <dc:subject>
        <rdf:Bag>
          <rdf:li>{flat}</rdf:li>
        </rdf:Bag>
      </dc:subject>

      <!-- Hierarchical keyword — appears as Wildlife > {group} > {label} -->
      <lr:hierarchicalSubject>
        <rdf:Bag>
          <rdf:li>{hierarchical}</rdf:li>
        </rdf:Bag>
      </lr:hierarchicalSubject>

    </rdf:Description>
  </rdf:RDF>
</x:xmpmeta>"""


def build_xmp(label: Column, group: Column, toolkit: str = "focuslake") -> Column:
    """The sidecar text. The comment holds group and label as they are, without escaping."""
    fields = {
        "flat": xml_escape(label),
        "group": group,
        "label": label,
        "hierarchical": xml_escape(hierarchical_keyword(group, label)),
    }
    pieces = re.split(r"\{(\w+)\}", XMP_TEMPLATE.replace("{toolkit}", toolkit))
    parts = [fields[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)]
    return F.concat(*parts)


def breaks_comment(label: Column) -> Column:
    """Two hyphens in a label end the sidecar's comment early, and strict readers then refuse the file."""
    return F.contains(label, F.lit("--"))


def sidecar_path(path: Column) -> Column:
    """The path with its last extension replaced by ``xmp``."""
    return F.concat(F.regexp_replace(path, r"([^/])\.[^./]+$", "$1"), F.lit(".xmp"))
