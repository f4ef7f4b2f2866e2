"""Reading exports through contracts, cleaning them, and writing tables and reports."""
