"""Reports and routines over the star schema."""
