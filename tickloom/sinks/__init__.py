"""Writers that publish only complete results."""
