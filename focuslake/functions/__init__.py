"""Pure ``Column -> Column`` functions."""
