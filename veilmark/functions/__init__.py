"""Part of veilmark."""
