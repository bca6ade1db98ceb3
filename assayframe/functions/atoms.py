"""Fixed-width atom lines and atom types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayframe.functions.numeric import parse_float, parse_int
from assayframe.functions.text import strip

# Atom types in their only accepted spelling.
CANONICAL_TYPES: tuple[str, ...] = (
    "Mg", "Mn", "Fe", "Zn", "Ca", "Cu", "Ni", "Co", "Cd", "Hg", "Na", "Ki",
    "Cl", "Br", "Si", "Se",
    "H", "HD", "HS", "C", "A", "N", "NA", "NS", "OA", "OS", "F", "P", "S",
    "SA", "I", "TZ", "G", "GA", "J", "Q",
)

# Metals, backbone names, polar hydrogen and pseudo-atom types.
METALS: tuple[str, ...] = (
    "ZN", "MG", "MN", "FE", "CA", "CU", "NI", "CO", "CD", "K", "NA_ION",
)
BACKBONE: tuple[str, ...] = ("N", "CA", "C", "O", "OXT")
POLAR_HYDROGEN = "HD"
ZINC_PSEUDO = "TZ"

# Columns of an atom line as (first column, width), counted from 1.
FIELD_COLUMNS: dict[str, tuple[int, int]] = {
    "serial": (7, 5),
    "name": (13, 4),
    "residue": (18, 3),
    "chain": (22, 1),
    "residue_seq": (23, 4),
    "x": (31, 8),
    "y": (39, 8),
    "z": (47, 8),
    "charge": (71, 6),
    "atom_type": (78, 2),
}


def is_atom_line(line: Column) -> Column:
    return line.startswith("ATOM") | line.startswith("HETATM")


def atom_fields(line: Column) -> dict[str, Column]:
    """Typed fields of an atom line; a field that does not parse is null."""

    def cut(field: str) -> Column:
        first, width = FIELD_COLUMNS[field]
        return F.substring(line, first, width)

    fields = {
        "serial": parse_int(cut("serial")),
        "name": strip(cut("name")),
        "residue": strip(cut("residue")),
        "chain": strip(cut("chain")),
        "residue_seq": parse_int(cut("residue_seq")),
        "x": parse_float(cut("x")),
        "y": parse_float(cut("y")),
        "z": parse_float(cut("z")),
    }
    has_charge = F.length(line) >= FIELD_COLUMNS["charge"][0]
    fields["charge"] = F.when(has_charge, parse_float(cut("charge"))).otherwise(F.lit(0.0))
    fields["atom_type"] = strip(cut("atom_type"))
    return fields


REQUIRED_FIELDS = ("serial", "residue_seq", "x", "y", "z", "charge")


def is_metal(atom_type: Column) -> Column:
    return F.upper(atom_type).isin(*METALS)


def canonical_type(atom_type: Column) -> Column:
    """Accepted spelling of a type, null for an unknown type.

    A type that is already spelled as accepted stays; that keeps sodium (``Na``)
    apart from the acceptor nitrogen (``NA``).
    """
    by_upper = {t.upper(): t for t in CANONICAL_TYPES}
    pairs = [F.lit(v) for item in by_upper.items() for v in item]
    looked_up = F.try_element_at(F.create_map(*pairs), F.upper(atom_type))
    return F.when(atom_type.isin(*CANONICAL_TYPES), atom_type).otherwise(looked_up)


def repaired_line(line: Column) -> Column:
    """The line with its type field (columns 78-79) in accepted spelling."""
    current = strip(F.substring(line, 78, 2))
    wanted = canonical_type(current)
    applies = is_atom_line(line) & (F.length(line) >= 79) & (wanted != current)
    fixed = F.concat(F.substring(line, 1, 77), F.rpad(wanted, 2, " "), F.substring(line, 80, 1 << 30))
    return F.when(applies, fixed).otherwise(line)
