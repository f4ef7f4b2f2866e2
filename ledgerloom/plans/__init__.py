"""From paths to tables, and from tables to workpapers."""
