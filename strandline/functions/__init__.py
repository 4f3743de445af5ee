"""Column functions: the formula set, number and date parsing, units."""
