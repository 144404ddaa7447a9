"""No streaming operator is in scope: every job of this library is a batch job."""
