"""Planning patterns shared by the operators: ordered windows, groups, grids."""
