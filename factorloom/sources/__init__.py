"""Tables and factor stores on shared storage."""
