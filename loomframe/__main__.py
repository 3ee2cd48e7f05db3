from loomframe.plans.chain import main

main()
